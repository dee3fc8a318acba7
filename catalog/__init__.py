"""Registered queries: one per operator, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

import importlib

from catalog.registry import ORACLES, QUERIES

for _area in ("sources", "detect", "repair", "prepare", "judge", "learn", "measure", "runs"):
    importlib.import_module(f"catalog.{_area}")

__all__ = ["ORACLES", "QUERIES"]
