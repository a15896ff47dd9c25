"""Queries over the given tables, one or more per operator of the survey's inventory."""

from __future__ import annotations

import importlib

MODULES = ("aggregates", "outcomes", "windows", "joins", "detection_stats", "projections", "episodes", "storage")


def registered():
    """``(queries, oracles)`` of all catalog modules."""
    from kinetable.catalog import base

    for name in MODULES:
        importlib.import_module(f"kinetable.catalog.{name}")
    return base.QUERIES, base.ORACLES
