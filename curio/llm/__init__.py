"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  Functions defined here are shipped to
executors by value, so that executors need no copy of the library on their path.
"""

import sys

from pyspark import cloudpickle

from curio import tables

for _module in (sys.modules[__name__], tables):
    cloudpickle.register_pickle_by_value(_module)
