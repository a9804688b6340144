"""Registered queries over the driver tables and their DuckDB oracles.

Each module exposes ``QUERIES`` (name -> callable(spark, sf_dir) -> DataFrame)
and ``ORACLES`` (name -> DuckDB SQL). Queries without an oracle get the
driver's weaker rows-only check.
"""

from __future__ import annotations

import importlib

MODULES = ("reports", "logs", "shards", "inventory", "lifecycle", "files")


def all_queries() -> dict:
    out = {}
    for m in MODULES:
        out.update(importlib.import_module(f"suitelens.plans.{m}").QUERIES)
    return out


def all_oracles() -> dict:
    out = {}
    for m in MODULES:
        out.update(importlib.import_module(f"suitelens.plans.{m}").ORACLES)
    return out
