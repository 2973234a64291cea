"""Operators of a training-data pipeline over documents, conversations and benchmarks.

Nothing else in the library imports this package.  Its functions travel to the
executors by value, as the executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
