"""marksheet: learner analytics over answer logs, written as Spark jobs.

Every public function takes DataFrames and returns DataFrames.  Rows never pass through the
driver; only scalars, column lists and cut points do.
"""
import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
