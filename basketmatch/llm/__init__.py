"""Operators for preparing language-model training data; nothing outside imports this package.

Functions that run in Python workers travel with the job, so that executors need
numpy and pandas but no copy of this package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
