"""Management analytics for a construction group, written as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their task, so executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
