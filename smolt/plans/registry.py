"""Query catalogue: one entry per operator key of the survey (section 2).

Each entry is a callable ``(spark, sf_dir) -> DataFrame`` over the driver
tables (bindings in ``smolt.sources.tables``) and, where the operator is
SQL-expressible, an equivalent DuckDB SQL string used as the independent
correctness oracle. Column names match between the two.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = " ".join(sql.split())
        return fn
    return deco
