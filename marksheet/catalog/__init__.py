"""Registered queries: importing this package fills the registry."""
from marksheet.catalog import (  # noqa: F401
    answers, diagnosis, estimates, graded, measures, scores, sources, tracing, whole,
)
from marksheet.catalog.registry import ORACLE, QUERIES  # noqa: F401
