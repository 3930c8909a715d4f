"""Chapterloom: a PySpark engine for corpora of serialized fiction.

Operators take and return DataFrames; nothing here fetches from the network.
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so that
# executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
