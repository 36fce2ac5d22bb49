"""Mining of large text collections with PySpark."""

import sys

from pyspark.cloudpickle import cloudpickle

# Functions travel to executors with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
