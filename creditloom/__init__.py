"""creditloom: credit scorecards, text features and expected loss as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Functions of this package travel to executors by value: no installation there,
# and no dependence on the folder that workers start in.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
