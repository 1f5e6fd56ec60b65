"""Registered queries: operators bound to the driver tables, each beside its SQL twin."""

from __future__ import annotations

import importlib

MODULES = ("verdicts", "reports", "evaluation", "filters", "answers", "corpus", "relations", "exchange", "timelines")


def load_queries() -> dict:
    """Import every query module and return the registry."""
    from auditlake.plans.registry import QUERIES

    for name in MODULES:
        importlib.import_module(f"auditlake.plans.{name}")
    return QUERIES
