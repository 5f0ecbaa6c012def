"""Interval and label agreement analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# the few vectorised functions travel with the job; executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
