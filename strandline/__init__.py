"""strandline: archives of time-series data as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
