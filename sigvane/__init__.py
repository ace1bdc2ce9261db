"""Point-in-time signal research as ordinary Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Vectorized functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
