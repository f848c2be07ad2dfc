"""Column expressions of the response models."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scaling constant and the bounds of ability and item parameters.
SCALE = 1.702
THETA_BOUNDS = (-6.0, 6.0)
A_BOUNDS = (0.25, 5.0)
B_BOUNDS = (-6.0, 6.0)
C_BOUNDS = (0.0, 0.5)


@dataclass(frozen=True)
class ModelSpec:
    """Which parameters a response model frees, its number of dimensions rule and its link."""
    free: tuple[str, ...]
    multidimensional: bool = False
    compensatory: bool = True


MODELS = {
    "1PL": ModelSpec(("b",)),
    "2PL": ModelSpec(("a", "b")),
    "3PL": ModelSpec(("a", "b", "c")),
    "M2PL": ModelSpec(("a", "b"), True),
    "M3PL": ModelSpec(("a", "b", "c"), True),
    "M2PLN": ModelSpec(("a", "b"), True, False),
    "M3PLN": ModelSpec(("a", "b", "c"), True, False),
}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(x: Column, bounds: tuple[float, float]) -> Column:
    return F.least(F.greatest(x, F.lit(bounds[0])), F.lit(bounds[1]))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def linear(theta, a, b, form: str = "intercept", D: float = 1.0) -> Column:
    """Exponent of the logistic curve: a*theta+b, or D*a*(theta-b) in difficulty form."""
    theta, a, b = col(theta), col(a), col(b)
    if form == "intercept":
        return a * theta + b
    if form == "difficulty":
        return F.lit(float(D)) * a * (theta - b)
    raise ValueError(f"unknown form {form!r}")


def prob(theta="theta", a="a", b="b", c="c", form: str = "intercept", D: float = 1.0) -> Column:
    """Probability of a right answer under the three-parameter model."""
    return col(c) + (1 - col(c)) * sigmoid(linear(theta, a, b, form, D))


def prob4(theta, a="a", b="b", c="c", d="d", D: float = 1.0) -> Column:
    """Four-parameter curve in difficulty form."""
    return col(c) + (col(d) - col(c)) * sigmoid(linear(theta, a, b, "difficulty", D))


def bernoulli_log(y, p: Column) -> Column:
    """log P(answer) for one 0/1 answer; null for a missing one, which sums then skip."""
    return F.when(col(y) == 1, F.log(p)).when(col(y) == 0, F.log1p(-p))


def dot(x, y) -> Column:
    return F.aggregate(F.zip_with(col(x), col(y), lambda s, t: s * t), F.lit(0.0), lambda acc, v: acc + v)


def prob_compensatory(theta="theta", a="a", b="b", c="c") -> Column:
    """Multi-dimensional model where strong dimensions make up for weak ones."""
    return col(c) + (1 - col(c)) * sigmoid(dot(theta, a) - col(b))


def prob_noncompensatory(theta="theta", a="a", b="b", c="c") -> Column:
    """Multi-dimensional model that needs every dimension; ``b`` is an array."""
    each = F.zip_with(F.zip_with(col(theta), col(b), lambda t, s: t - s), col(a),
                      lambda t, s: sigmoid(t * s))
    return col(c) + (1 - col(c)) * F.aggregate(each, F.lit(1.0), lambda acc, v: acc * v)


def doubles(values) -> Column:
    """A literal array, as one expression."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def array_of(template: str, size: int) -> Column:
    """``array(f(0), f(1), ...)`` from an SQL template with ``{k}``, as one expression."""
    return F.expr("array(" + ", ".join(template.format(k=k) for k in range(size)) + ")")


def total(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, columns)
