"""Federated least-squares classification as a DataFrame workload on Spark."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel with their code, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
