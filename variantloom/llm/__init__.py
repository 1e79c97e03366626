"""Operators for preparing language-model training data."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the workers by value: workers need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
