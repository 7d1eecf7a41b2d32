"""Spark-native analytics over product reviews: selection, text preparation, opinion extraction, clustering and reports."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel with their code, so that executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
