"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and SQL that gives the same rows."""

from __future__ import annotations

import importlib

_MODULES = ["records", "catalog", "library", "graph", "ingest", "text", "stream", "wiki", "more", "search", "kgraph", "updates", "jobq", "intake", "scalars", "rest"]


def collect() -> tuple[dict, dict]:
    queries: dict = {}
    oracle: dict = {}
    for name in _MODULES:
        module = importlib.import_module(f"biblion.queries.{name}")
        queries.update(module.QUERIES)
        oracle.update(module.ORACLE)
    return queries, oracle
