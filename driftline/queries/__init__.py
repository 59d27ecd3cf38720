"""Queries that apply the operators to the supplied tables, each with the SQL an engine of its own answers it by."""

from __future__ import annotations

from importlib import import_module

MODULES = ("urls", "status", "text", "detect", "extract", "plan", "streams")


def collected() -> tuple[dict, dict[str, str]]:
    queries: dict = {}
    oracles: dict[str, str] = {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
