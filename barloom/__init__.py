"""Bar-series analytics expressed as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Task-side helpers travel with the task, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
