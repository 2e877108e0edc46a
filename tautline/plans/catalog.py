"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from tautline.plans import graphs, history, links  # noqa: F401
from tautline.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
