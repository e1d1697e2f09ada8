"""Offer-targeting analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so executors need not
# have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
