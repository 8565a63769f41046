"""Spatial operations analytics and training-data operators on PySpark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value: a cluster needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
