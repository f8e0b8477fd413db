"""Spark jobs for market and lead intelligence."""

from pyspark import cloudpickle as _cloudpickle

# Task functions travel with their code, so executors need no copy of the package.
_cloudpickle.register_pickle_by_value(__import__(__name__))
