"""Two-source entity resolution under a label budget, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from pairloom.config import PRESETS, MatchConfig

# Functions of this package travel to the executors by value, so a cluster needs
# no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["MatchConfig", "PRESETS"]
