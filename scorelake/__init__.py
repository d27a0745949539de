"""scorelake: weighted-criteria analytics expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run on executors travel with their code, so that workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
