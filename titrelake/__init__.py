"""Measurement comparability and evidence analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get the functions themselves, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
