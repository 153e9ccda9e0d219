"""weft: a property-graph analytics engine that runs as ordinary Spark plans."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
