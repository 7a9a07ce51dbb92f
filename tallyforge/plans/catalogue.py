"""All registered queries of the core engine, area by area."""

from __future__ import annotations

from . import q_analytics, q_catalog, q_drafts, q_entities, q_evaluation, q_models, q_more, q_review, q_rules, q_sources  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
