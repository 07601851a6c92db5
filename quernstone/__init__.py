"""Quernstone: a Spark-native engine for document, graph and retrieval analytics.

Functions that Python workers run are pickled by value, so executors need no
copy of this package on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
