"""Code-navigation analytics on Spark: parse, resolve, walk and search a code index."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel with their code: workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
