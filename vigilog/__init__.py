"""vigilog: application logs -> signals -> incidents -> responses, on Spark.

Every step is a function ``DataFrame -> DataFrame``.
"""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python workers travel with the task, so
# executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
