"""Spark-native analytics for multi-sensor time series, statistics and corpora.

Executor code is shipped by value, so workers need no copy of this package on
their import path.
"""

from pyspark import cloudpickle
import sys

cloudpickle.register_pickle_by_value(sys.modules[__name__])
