"""Operators of a training-data pipeline: sharding, decontamination, scans, formatting, scoring."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors as code, which then need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
