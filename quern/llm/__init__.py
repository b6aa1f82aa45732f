"""Operators for preparing training text. Nothing outside this package imports it."""

from __future__ import annotations

import importlib

_MODULES = ["site_lines", "encoding", "content", "lang_id", "value_map", "rank_flow", "packing", "mixing"]

QUERIES: dict = {}
ORACLE: dict = {}
for _name in _MODULES:
    _module = importlib.import_module(f"quern.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
