"""Spark-native analytics for how text spreads through a stream of posts."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
