"""Log, trace and service-level analytics as DataFrame -> DataFrame functions on Spark."""

import sys

from pyspark import cloudpickle

# Functions handed to Spark tasks travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
