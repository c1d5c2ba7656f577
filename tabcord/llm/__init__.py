"""Operators for training-data pipelines.

Each module holds one operator with its own interface; :mod:`.queries` binds
them to the shared tables.  Functions that run inside tasks travel by value,
so executors need no copy of this package on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
