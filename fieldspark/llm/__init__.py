"""Operators for preparing language-model training data at corpus scale.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Executors get these functions by value, so they need no copy of the library.
register_pickle_by_value(sys.modules[__name__])
