"""sheaf: DataFrame operators for loading, enriching, searching and summarising text records."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run inside tasks are sent with their code, so that executors need not have
# this package installed or on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
