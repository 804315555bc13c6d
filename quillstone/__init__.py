"""PySpark-native engine for chunking, indexing and searching text corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package that run on executors are sent whole: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
