"""Spark-native catalog retrieval, curriculum analytics and corpus preparation."""

import sys

from pyspark import cloudpickle

# executors need no copy of this package: functions of its Python tasks travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])
