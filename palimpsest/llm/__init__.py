"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions shipped to executors travel by value, so executors need no copy of this repository.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
