"""Operators of a training-data pipeline; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Ship the functions that run in tasks inside the job, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
