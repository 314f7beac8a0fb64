"""Every query of the engine by name, with oracle SQL."""

from __future__ import annotations

from .queries import graphs, retrieval, texts  # noqa: F401  (they register themselves)
from .queries.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
