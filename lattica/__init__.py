"""lattica: a PySpark-native analytics engine (DataFrame, SQL and Structured Streaming first).

Python functions of this package travel to executors by value, so a cluster needs no copy of it.
"""

import sys

from pyspark import cloudpickle

from lattica.session import build_session, read_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "read_table"]
