"""Operators of a training-data pipeline: exact and near duplicates, benchmark
decontamination, mixing, secrets, fingerprints, quality and URL filters.

Nothing outside this subpackage imports it.  Functions that run in Python
workers are sent by value, so executors need no copy of the package."""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
