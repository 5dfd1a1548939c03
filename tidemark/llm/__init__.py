"""Operators of a training-data pipeline: sharding, deduplication, filtering, packing, archives."""

import sys

from pyspark import cloudpickle

# Tasks get this package's functions with the job, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
