"""A Spark-native engine for finding, replacing and counting sensitive values in text."""

import sys

from pyspark import cloudpickle

# Functions and classes of this package travel to the executors by value, so that nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
