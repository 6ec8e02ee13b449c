"""Spark jobs that turn web pages into chat-format instruction data."""

import sys

from pyspark import cloudpickle

# Ship the package's own functions inside pickled UDFs, so that executors need
# no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
