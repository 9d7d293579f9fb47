"""Document retrieval and inventory analytics as Spark table jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with the job, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
