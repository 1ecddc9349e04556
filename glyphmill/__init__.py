"""glyphmill: ranked text search and text analytics expressed as Spark plans."""

import sys

from pyspark import cloudpickle

from glyphmill.config import IndexConfig
from glyphmill.operators.index import SearchIndex, build_index

# Functions of this package travel to the workers by value, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["IndexConfig", "SearchIndex", "build_index"]
