"""Spark-first engine for relational, property-graph and vector analytics.

Everything is expressed over DataFrames; Catalyst and AQE choose the physical
strategy. Functions that run in Python workers are pickled by value so that
executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
