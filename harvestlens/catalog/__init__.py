"""Registered queries: operators run on the given tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

from importlib import import_module

MODULES = ("daily", "counties", "serving", "versions", "training")


def load() -> dict:
    """All registered queries by name."""
    from harvestlens.catalog.registry import QUERIES

    for m in MODULES:
        import_module(f"harvestlens.catalog.{m}")
    return QUERIES
