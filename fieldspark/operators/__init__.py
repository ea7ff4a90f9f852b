"""Operators that plans are made of."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Executors get these functions by value, so they need no copy of the library.
register_pickle_by_value(sys.modules[__name__])
