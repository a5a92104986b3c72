"""All named queries of the library, without the llm subpackage."""

from . import cells, code, graph, io, metrics, ml, records, retrieval, sequences, streams, text  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
