"""Training-data operators. Nothing else in the library imports this package.

Functions that run in tasks are sent by value, so executors need numpy, pandas and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
