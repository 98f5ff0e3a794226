"""All queries of the engine's own operators, and the SQL that their results are held against."""

from __future__ import annotations

from findoc.plans import flows, grounding, misc, models, search, statements, text  # noqa: F401
from findoc.plans.base import ORACLES, QUERIES

FLAGSHIP = "rerank_hybrid"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
