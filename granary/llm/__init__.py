"""Training-data operators.  Nothing else in the library imports this subpackage.

Functions of this subpackage travel to the Python workers by value: executors need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
