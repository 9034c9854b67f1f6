"""specweave: bulk reconciliation of data-request specifications on Spark.

Every operator takes DataFrames and returns DataFrames; actions are left to the
caller.  See README.md for the map of modules.
"""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
