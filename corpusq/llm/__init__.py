"""Training-data operators. Nothing outside this subpackage imports it.

Functions handed to Python workers are pickled by value, so that executors
need neither this package on their path nor a copy of the driver's folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
