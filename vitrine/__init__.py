"""Retail-offer analytics as composable Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# the small Python helpers travel with the tasks, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
