"""Catalogue analytics on PySpark: every operator maps DataFrames to a DataFrame."""

import sys

from pyspark import cloudpickle

# Tasks get the code they run with their closure, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
