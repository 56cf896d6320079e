"""Operators for training-data pipelines.

Functions of this package that run inside tasks travel with the task, so executors need only
the third-party libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
