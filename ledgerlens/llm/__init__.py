"""Operators for large text corpora. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel with their code, so workers need no path to this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
