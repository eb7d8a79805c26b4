"""Operators for training-data pipelines. Nothing else in the package imports this folder."""

from pyspark import cloudpickle

import staylens

# Functions travel to the executors by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(staylens)
