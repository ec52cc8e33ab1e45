"""shelfmark: catalogue analytics for large file collections, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
