"""Operators of a training-data pipeline over document tables.

Functions of this package travel to the Python workers by value, so executors need numpy, pandas,
pyarrow and the few libraries the operators import, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
