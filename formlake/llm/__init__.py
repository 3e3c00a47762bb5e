"""Operators for preparing text corpora; nothing else in the package imports this folder.

Functions that run inside tasks travel with them, so executors need the installed libraries but
not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
