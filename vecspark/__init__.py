"""Vector analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get the kernels with the task, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
