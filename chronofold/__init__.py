"""chronofold: run-journal analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Python functions that run on executors travel by value: a cluster need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
