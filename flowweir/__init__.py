"""flowweir: network-flow analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the plan, so executors need
# not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
