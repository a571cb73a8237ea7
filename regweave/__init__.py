"""Regulatory-network analytics on Spark DataFrames.

Subpackages: ``functions`` (column expressions and small numeric helpers),
``operators`` (DataFrame -> DataFrame building blocks), ``sources`` (readers
and the network store), ``plans`` (composed end-to-end jobs) and ``catalog``
(the registered example queries).
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions shipped to Python workers travel by value, so executors need no
# installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
