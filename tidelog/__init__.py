"""Change-data analytics on Spark: snapshots, changelogs, keyed state, envelopes."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions travel by value with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
