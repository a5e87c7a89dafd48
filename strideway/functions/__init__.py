"""Functions that run in Python workers travel with the plan, so workers need not have this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
