"""Collect, clean, merge, search, score and rank listing records with Spark."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so nothing must be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
