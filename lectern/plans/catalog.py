"""All registered queries of the narration operators and their DuckDB twins."""
from . import chapter_queries, layout_queries, source_queries, state_queries, stream_queries, text_queries, work_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
