"""sluice: tabular ingestion, profiling and versioning as Spark jobs."""

import sys

from pyspark import cloudpickle

# Tasks get the few Python helpers by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
