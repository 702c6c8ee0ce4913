"""Operators for training-data pipelines over documents, pages and benchmarks.

Functions of this package that run in executors are sent by value, so the
executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
