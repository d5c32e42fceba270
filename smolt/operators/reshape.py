"""Set operations and reshaping (survey 2.8)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_fill(*dfs: DataFrame) -> DataFrame:
    """``bind_rows``: align by name, missing columns become NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def union_strict(*dfs: DataFrame) -> DataFrame:
    """``rbind``: align by name, the same columns required."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def unpivot_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str] | None = None,
                 key: str = "key", value: str = "value", drop_nulls: bool = False) -> DataFrame:
    """``gather(df, key, value, -ids)``: every non-id column becomes a row.

    A narrow transformation (``Expand``): no shuffle.
    """
    cols = [c for c in (cols or df.columns) if c not in ids]
    out = df.unpivot(list(ids), cols, key, value)
    return out.filter(F.col(value).isNotNull()) if drop_nulls else out


def pivot_indicator(df: DataFrame, ids: Sequence[str], names_from: str,
                    values: Sequence, prefix: str = "", fill: int = 0) -> DataFrame:
    """``pivot_wider(values_fill = 0, names_prefix=)`` of a presence flag.

    ``values`` is the explicit, ordered list of columns (survey D8, D9).
    """
    g = df.groupBy(*ids).pivot(names_from, list(values)).agg(F.max(F.lit(1)))
    ren = {str(v): f"{prefix}{v}" for v in values}
    g = g.withColumnsRenamed(ren)
    return g.fillna(fill, subset=list(ren.values()))


def unite(df: DataFrame, out: str, cols: Sequence[str], sep: str = "",
          remove: bool = True) -> DataFrame:
    """``unite(df, out, cols, sep)``: NULL prints as ``NA`` like R."""
    from smolt.functions.scalars import paste
    r = df.withColumn(out, paste(*cols, sep=sep))
    return r.drop(*cols) if remove else r


def add_event_rows(events: DataFrame, anchors: DataFrame, key: str, ts_col: str,
                   anchor_ts: str, literals: Mapping[str, object]) -> DataFrame:
    """Synthesize one event row per anchor (e.g. a release) and stack it on
    the event stream by name (``mutate(Receiver = 'release') %>% rbind``)."""
    rows = anchors.select(F.col(key), F.col(anchor_ts).alias(ts_col),
                          *[(v if isinstance(v, Column) else F.lit(v)).alias(k)
                            for k, v in literals.items()])
    return events.unionByName(rows, allowMissingColumns=True)
