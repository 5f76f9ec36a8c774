"""Market-microstructure screening as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Grouped-map helpers travel with the task, so executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
