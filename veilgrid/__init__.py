"""Privacy analytics on Spark: detect, classify, score, redact, screen and report."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: they needn't have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
