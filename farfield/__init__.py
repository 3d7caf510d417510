"""Density-based outlier detection on Spark tables and streams."""

import sys

from pyspark import cloudpickle

# Task code travels inside the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
