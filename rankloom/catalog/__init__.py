"""Registered queries over the driver tables, each next to its oracle statement."""

from __future__ import annotations

from importlib import import_module

MODULES = ["scoring", "ranked", "selection", "structures", "fitted", "measures", "composed"]


def _collect(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        part = getattr(import_module(f"rankloom.catalog.{m}"), attr)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("SQL")
