"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ("language", "simhash", "packing", "secrets", "warc", "urlfilter", "htmltext", "neighbours", "decontam", "pii", "infill", "periods", "repeats")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"gaugeworks.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(getattr(_module, "ORACLES", {}))
