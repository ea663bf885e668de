"""tidemark: versioned, keyed tables and ranked retrieval as Spark plans."""

from tidemark.operators.index import CustomIndex, Index
from tidemark.operators.reads import Bound, excluded, included
from tidemark.sources.manifest import TableDef
from tidemark.sources.store import Config, Store
from tidemark.sources.vectors import VectorCollection

__all__ = ["Bound", "Config", "CustomIndex", "Index", "Store", "TableDef", "VectorCollection", "excluded", "included"]
