"""flowrisk: behavioural risk analytics on audit and activity logs, written for Spark."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so the workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
