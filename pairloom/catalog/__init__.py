"""The registered queries over the given tables, each beside its SQL."""

from pairloom.catalog import fixed, labelling, learning, metrics, neighbours, tables
from pairloom.catalog.base import REGISTRY, Query

MODULES = (tables, neighbours, labelling, metrics, learning, fixed)

__all__ = ["REGISTRY", "Query", "MODULES"]
