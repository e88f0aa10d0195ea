"""Disclosure-text analytics on Spark."""

import sys

from pyspark import cloudpickle

# Python tasks take the package's functions along, so that executors needn't have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
