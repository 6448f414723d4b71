"""All registered queries and the SQL they are compared with."""

from __future__ import annotations

from . import depth_queries, episode_queries, evidence_queries, extra_queries, extraction_queries, landmark_queries, layer_queries, motion_queries, report_queries, resolve_queries, series_queries, store_queries, text_queries  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
