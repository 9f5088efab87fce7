"""Plans over the given tables: each registers its queries and their SQL."""

from . import answering, assembling, chunking, files, graphs, lifecycle, operations, parsing, retrieval, symbols
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "answering", "assembling", "chunking", "files", "graphs", "lifecycle", "operations", "parsing", "retrieval", "symbols"]
