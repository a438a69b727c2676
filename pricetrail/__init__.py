"""Price-observation analytics as PySpark table-to-table operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python helpers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
