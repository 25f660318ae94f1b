"""Spark operators for profiling measurement tables and checking analyses of them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code, so that a job runs from
# any working folder and no executor needs the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.2.0"
