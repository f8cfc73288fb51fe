"""Group profiles and match scores on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need no copy of the
# package and it does not matter where the driver was started.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
