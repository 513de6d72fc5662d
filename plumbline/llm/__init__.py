"""Training-data operators: filtering, deduplication, mixing and export of text corpora."""

import sys

from pyspark import cloudpickle

# Task code travels with the job, so executors need NumPy and PyArrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
