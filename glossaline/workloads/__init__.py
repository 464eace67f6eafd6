"""Queries over the given tables, by subject."""

from . import (  # noqa: F401
    catalog_queries, layout_queries, memory_queries, quality_queries, stream_queries, text_queries, work_queries,
)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
