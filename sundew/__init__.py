"""sundew: a Spark-native engine that finds, verifies, scores and reports personal information in text and code.

Everything is a function from DataFrames (or Columns) to DataFrames (or Columns).  Python kernels run on Arrow
batches; they are pickled by value so that executors need no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
