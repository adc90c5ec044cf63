"""Spark jobs for multi-tenant event tracking: normalise, filter, roll up, match, serve."""

import sys

from pyspark import cloudpickle

# Send the package's Python functions to executors by value: they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
