"""Cross-sectional factor research on bar data, written as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# functions run in Python workers travel with the job, so workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
