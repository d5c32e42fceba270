"""R-compatible NULL rules as Spark column expressions (survey 1.3).

Spark's three-valued logic differs from R's vector semantics in a few
places that change results; each helper here encodes one rule so that
operators never have to re-derive it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def isin_safe(c, values: Iterable) -> Column:
    """``x %in% S``: FALSE (never NULL) when x is NULL or S holds no match.

    A NULL inside ``values`` matches a NULL x, as in R.
    """
    vals = list(values)
    c = _col(c)
    non_null = [v for v in vals if v is not None]
    hit = c.isin(non_null) if non_null else F.lit(False)
    if len(non_null) != len(vals):
        hit = hit | c.isNull()
    return F.coalesce(hit, F.lit(False))


def not_in_safe(c, values: Iterable) -> Column:
    """``!x %in% S``: keeps NULL x unless NULL is listed in S."""
    return ~isin_safe(c, values)


def null_or_in(c, values: Iterable) -> Column:
    """``x %in% c(NA, ...)``: TRUE for NULL x or membership."""
    c = _col(c)
    return c.isNull() | isin_safe(c, values)


def if_else(cond: Column, yes, no) -> Column:
    """``ifelse(cond, a, b)``: NULL when the condition is NULL.

    ``F.when(cond, a).otherwise(b)`` would return ``b`` for a NULL
    condition, which is not what R does.
    """
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes).otherwise(no)


def count_distinct_na(c) -> Column:
    """``length(unique(x))``: distinct values, NULL counted as one value."""
    c = _col(c)
    return (F.count_distinct(c)
            + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))).cast("long")


def sum_strict(c) -> Column:
    """``sum(x)`` without ``na.rm``: NULL as soon as one input is NULL."""
    c = _col(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))
