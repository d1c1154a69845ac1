"""Training-data operators: deduplication, filtering, mixing, scoring, search and token output."""

import sys

from pyspark import cloudpickle

# What runs inside tasks travels with the tasks; executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
