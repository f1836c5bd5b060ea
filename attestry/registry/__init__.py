"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from attestry.registry.base import ORACLES, QUERIES

_MODULES = ["scoreboard", "catalog", "ingest", "runs", "texts", "contracts", "files", "streams"]

for _name in _MODULES:
    import_module(f"attestry.registry.{_name}")

__all__ = ["ORACLES", "QUERIES"]
