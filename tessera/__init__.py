"""tessera: analytics over code-like metadata and text, on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel whole, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
