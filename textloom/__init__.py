"""Corpus preparation and text scoring as Spark DataFrame programs.

Functions that run inside Python workers are pickled by value, so executors
need nothing but PySpark, numpy, pandas and Arrow on their path.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
