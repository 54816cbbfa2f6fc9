"""Operators of a training-data pipeline.  Nothing outside this subpackage
imports it; ``queries`` holds the registered queries.

The package is pickled by value, so Python workers need no import path to it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
