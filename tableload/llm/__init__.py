"""Operators that prepare text, pages and vectors for language-model training."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the plan, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
