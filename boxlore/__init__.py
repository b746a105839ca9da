"""Detection-data analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so a session started from any
# folder, on machines without this package, can run them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
