"""Queries over the supplied tables."""

from __future__ import annotations

import importlib

MODULES = ("relational", "windowing", "statistics", "signals", "tables", "files")


def load_queries() -> dict:
    """Import the query modules and return the registry in their order."""
    from physio_spark.plans.registry import REGISTRY

    for name in MODULES:
        importlib.import_module(f"physio_spark.plans.{name}")
    return REGISTRY
