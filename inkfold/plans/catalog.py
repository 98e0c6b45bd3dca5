"""All queries of the page and text engine."""

from __future__ import annotations

from inkfold.plans import chapter_queries, file_queries, line_queries, model_queries, region_queries, request_queries, stage_queries, tile_queries  # noqa: F401
from inkfold.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "assign_balloons"
