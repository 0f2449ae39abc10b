"""Registered queries and their DuckDB twins."""

from . import basics, detail_scores, details, elements, expressions, features, feeds, scoring, tables, training
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "basics", "detail_scores", "details", "elements", "expressions", "features", "feeds", "scoring", "tables", "training"]
