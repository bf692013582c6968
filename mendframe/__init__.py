"""Profiling, diagnosis and repair of labelled tables as Spark jobs."""

import sys

from pyspark import cloudpickle

# Ship the few Python functions that run in tasks by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
