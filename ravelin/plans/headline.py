"""All queries of the engine, and the one that stands for it."""

from __future__ import annotations

from . import documents, feeds, flows, indicators, relations, texts  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

FLAGSHIP = "ioc_score_newest"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
