"""Registered queries: each pairs a Spark plan with the SQL that states the same result."""

from __future__ import annotations

import importlib

MODULES = ["html_queries", "text_queries", "job_queries", "page_queries", "legal_queries", "contract_queries", "line_queries", "source_queries", "stream_queries"]


def load_all():
    """Import every query module and return ``(queries, oracles)``."""
    from quirekit.plans import registry

    for name in MODULES:
        importlib.import_module(f"quirekit.plans.{name}")
    return registry.QUERIES, registry.ORACLES
