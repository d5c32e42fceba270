"""Row filters with R's NULL semantics (survey 2.3)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smolt.functions.nullsafe import isin_safe, not_in_safe


def filter_in(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    """``filter(x %in% S)`` (NULL x dropped)."""
    return df.filter(isin_safe(col, values))


def filter_not_in(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    """``filter(!x %in% S)`` (NULL x kept)."""
    return df.filter(not_in_safe(col, values))


def drop_na(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``drop_na(df, cols)``."""
    return df.dropna(subset=list(cols))


def keep_na(df: DataFrame, col: str) -> DataFrame:
    """``filter(is.na(x))``."""
    return df.filter(F.col(col).isNull())


def filter_expr(df: DataFrame, cond: Column) -> DataFrame:
    """``filter(cond)``: rows whose condition is NULL are dropped, as in R."""
    return df.filter(cond)


def deny_pairs(df: DataFrame, from_col: str, to_col: str,
               pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Drop rows whose (from, to) pair is listed.

    ``!paste(from, to) %in% deny``: a row with a NULL end is kept (its
    pasted text contains "NA" and matches no listed pair). The literal list
    is a set lookup in the scan's stage: no join.
    """
    listed = F.struct(F.col(from_col), F.col(to_col)).isin([F.struct(F.lit(a), F.lit(b)) for a, b in dict.fromkeys(pairs)])
    return df.filter(F.col(from_col).isNull() | F.col(to_col).isNull() | ~listed)
