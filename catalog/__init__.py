"""Registered queries: each runs an operator over the given tables, most with SQL to check it."""

from __future__ import annotations

from .base import ORACLES, QUERIES
from . import classify, companies, enrichment, feeds, filters, resolution, summaries  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
