"""Search and index maintenance for document collections, as Spark plans."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions by value: no installation on executors is needed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
