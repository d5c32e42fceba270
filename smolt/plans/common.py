"""Helpers shared by the catalogue modules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Round computed doubles for the oracle comparison (both sides)."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


STATS = ("min", "max", "mean", "sd", "median")


def stats_sql(x: str) -> str:
    """SQL of ``aggregates.stats_exprs`` (n counts rows, others drop NULL)."""
    return (f"CAST(count(*) AS BIGINT) AS n, round(min({x}), 6) AS min, round(max({x}), 6) AS max, "
            f"round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS sd, "
            f"round(quantile_cont({x}, 0.5), 6) AS median")
