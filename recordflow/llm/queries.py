"""All queries of this package."""

from __future__ import annotations

from recordflow.llm import (  # noqa: F401
    join_queries, leak_queries, license_queries, mix_queries, page_queries, pii_queries, quality_queries, run_queries, text_queries, trie_queries, url_queries,
)
from recordflow.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
