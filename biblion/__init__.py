"""biblion: literature analytics expressed as Spark plans."""

import sys

from pyspark import cloudpickle

from biblion.session import checkpoint, get_session, table

# Functions that run in Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["checkpoint", "get_session", "table"]
