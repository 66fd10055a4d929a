"""parallaxa: matching, similarity, graph and incremental analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in tasks travel with their code, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
