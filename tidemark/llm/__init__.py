"""Operators that prepare training data. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value: workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
