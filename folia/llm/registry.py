"""The queries and oracle SQL of this subpackage."""

from __future__ import annotations

import importlib

MODULES = ["decontaminate", "minhash", "substrings", "quality", "bpe", "maxent", "secrets", "rules", "html_text", "sharding"]


def collect() -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"folia.llm.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql | importlib.import_module("folia.llm.oracles").SQL
