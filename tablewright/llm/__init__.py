"""Operators for preparing language-model training data. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors inside the plan, so the cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
