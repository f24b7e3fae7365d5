"""Physiological-session analytics as plain Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

# functions that run on workers travel with their code: no worker needs this folder on its path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
