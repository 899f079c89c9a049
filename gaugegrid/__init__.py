"""Analytics for networks of fixed gauges that report on a regular time grid, written for Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so the workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
