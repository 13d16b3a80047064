"""turnmill: conversational-corpus preparation, packing and evaluation on PySpark.

Every operator takes and returns DataFrames (or Columns); Catalyst plans the work and
Spark shuffles it.  Results never depend on the number of partitions or executors.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python workers travel with the plan, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
