"""Imports every module that registers queries."""

from __future__ import annotations

from glosswork.plans import audit, ingest, ledger, links, spans, texts  # noqa: F401
from glosswork.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
