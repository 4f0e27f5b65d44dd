"""All registered queries and their oracle SQL, by key."""

from __future__ import annotations

import importlib
import importlib.util

AREAS = ("quality", "profiles", "storage", "features", "models", "governance", "monitoring", "streams")


def _collect(name: str) -> dict:
    found: dict = {}
    for area in AREAS:
        if importlib.util.find_spec(f"gaugeworks.plans.{area}") is None:
            continue
        module = importlib.import_module(f"gaugeworks.plans.{area}")
        for key, value in getattr(module, name).items():
            if key in found:
                raise ValueError(f"query {key} is registered twice")
            found[key] = value
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
