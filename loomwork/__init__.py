"""loomwork: analytics, profiling and data-preparation operators on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
