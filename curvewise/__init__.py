"""Response-curve analytics as Spark DataFrame operators.

Factor names, the x column and the response column are parameters of every
operator, so the same code runs on any observation table.
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers are shipped with the job, so that the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
