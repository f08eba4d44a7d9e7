"""Spec-driven source-to-target data mapping on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Ship the package's few Python functions with the task, so that executors
# need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
