"""Training-data operators: licences, HTML, token files, secrets, near copies, leaks, quality, toxicity, language, packing."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage go to the executors by value, so they need no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
