"""Operators on stops, services, stations and scores.

The few functions that run in Python inside tasks are sent there by value, so a
cluster needs no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
