"""Registered queries, grouped by the part of the workflow they exercise."""

from __future__ import annotations

import importlib

GROUPS = ("profiling", "scoring", "generation", "source", "workflow")


def load_queries():
    """Import every query module once and return ``(queries, oracles)``."""
    from evalspark.plans import registry

    for group in GROUPS:
        importlib.import_module(f"evalspark.plans.{group}_queries")
    return registry.QUERIES, registry.ORACLES
