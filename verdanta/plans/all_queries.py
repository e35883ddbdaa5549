"""Imports every module that registers queries."""

from __future__ import annotations

from verdanta.plans import queries_align, queries_evaluate, queries_facts, queries_graph, queries_io, queries_layout, queries_providers  # noqa: F401  they register their queries
from verdanta.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
