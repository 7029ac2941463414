"""Palimpsest: a PySpark engine for multi-version key-value data.

Every operator is a function from DataFrames to a DataFrame over one canonical
schema, ``cells(key, seq, value, is_tombstone)``; :mod:`palimpsest.store` puts a
store with files, versions and pins on top of them.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel with their code, so that nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
