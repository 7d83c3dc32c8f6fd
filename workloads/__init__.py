"""Queries over the given tables, one or more per operator."""

import importlib

MODULES = ("tables", "series", "modelling", "shapes", "pipelines")


def load():
    """Import every query module; returns (queries, SQL checks)."""
    for name in MODULES:
        importlib.import_module(f"workloads.{name}")
    from workloads.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
