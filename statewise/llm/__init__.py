"""Operators for building training data from text corpora."""

import sys

from pyspark import cloudpickle

# Task functions travel with what they use, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
