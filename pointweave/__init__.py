"""Versioned point-and-edge analytics, and corpus preparation, on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside tasks travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
