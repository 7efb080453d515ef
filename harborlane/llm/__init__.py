"""Operators for preparing training text; nothing else in the library imports them.

Functions that run in Python workers travel with their task, so executors need not have the library
installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
