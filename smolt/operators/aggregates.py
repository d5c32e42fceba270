"""Aggregations (survey 2.5).

Counts, sums, extremes, means and variances are hash aggregates with
map-side partial aggregation, so a hot group is reduced in every input
task before the shuffle. Exact quantiles need order statistics: a sketch of
known rank error brackets every wanted rank, one more pass counts the values
inside the brackets and the rows between them, and ranks follow from these
counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smolt.functions.nullsafe import count_distinct_na, sum_strict


def count_rows(df: DataFrame, by: Sequence[str], out: str = "n") -> DataFrame:
    """``group_by(by) %>% summarise(n())`` (whole-table when ``by`` empty)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def count_distinct(df: DataFrame, by: Sequence[str], col: str, out: str = "n",
                   na_as_value: bool = True) -> DataFrame:
    """``length(unique(x))`` per group; NULL counts as one value in R."""
    expr = count_distinct_na(col) if na_as_value else F.count_distinct(col).cast("long")
    return df.groupBy(*by).agg(expr.alias(out))


def sum_by(df: DataFrame, by: Sequence[str], col: str, out: str = "total",
           na_rm: bool = False) -> DataFrame:
    """``summarise(sum(x))``: NULL when any input is NULL unless ``na_rm``."""
    expr = F.sum(col) if na_rm else sum_strict(col)
    return df.groupBy(*by).agg(expr.alias(out))


#: A quantile sketch's rank error is a group's rows divided by this. A group
#: with more rows has its brackets from the sketch, 8 / ACCURACY of its rows
#: wide; a smaller one is bracketed by its extremes.
ACCURACY = 20_000
_INF = float("inf")


def _key_join(rows: DataFrame, groups: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``rows`` with columns of the group table, which has each group's
    number of values ``__n``. Rows stay in their task: only groups of more
    than ``ACCURACY`` values are broadcast, at most one per ``ACCURACY``
    rows, and the rows of smaller ones get NULL. Without keys the one row of
    the group table is a scalar subquery."""
    if by:
        large = groups.where(F.col("__n") > ACCURACY).select(*by, *cols)
        return _join_by_keys(rows, F.broadcast(large), by, "left")
    one = groups.select(F.struct(*cols).alias("s")).scalar()
    return rows.withColumn("__one", one).select(*rows.columns, *[F.col("__one")[c].alias(c) for c in cols])


def _sketched(df: DataFrame, value: str, by: Sequence[str], probs: Sequence[float], more: Sequence[Column] = ()) -> DataFrame:
    """One aggregate per group: its number of values ``__n``, brackets
    ``__lo{k}``, ``__hi{k}`` that hold the order statistics around quantile
    k, and the columns of ``more``."""
    x = F.col(value).cast("double")
    wide = 4.0 / ACCURACY
    ends = [e for p in probs for e in (max(0.0, p - wide), min(1.0, p + wide))]
    # the sketch only compares; NaN goes with the infinities it follows
    plain = F.when(F.isnan(x), F.lit(_INF)).otherwise(x)
    g = df.groupBy(*by).agg(F.percentile_approx(plain, F.array(*map(F.lit, ends)), ACCURACY).alias("__q"), F.count(x).alias("__n"),
                            F.min(x).alias("__min"), F.max(x).alias("__max"), *more)
    small = F.col("__n") <= ACCURACY
    cols = {}
    for k in range(len(probs)):
        lo, hi = F.col("__q")[2 * k], F.col("__q")[2 * k + 1]
        cols[f"__lo{k}"] = F.when(small | (F.lit(ends[2 * k]) == 0), F.col("__min")).otherwise(lo)
        cols[f"__hi{k}"] = F.when(small | (F.lit(ends[2 * k + 1]) == 1) | (hi == _INF), F.col("__max")).otherwise(hi)
    g = g.withColumns(cols).drop("__q", "__min", "__max")
    # kept whole, not pruned for each reader, so that all of them share one exchange and one read of the input
    return g.select(F.inline(F.array(F.struct(*g.columns))))


def _ranked(df: DataFrame, value: str, by: Sequence[str], groups: DataFrame, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Quantiles from the brackets of ``_sketched``: (by..., __n, names...).
    Every value of a group of at most ``ACCURACY`` is ranked."""
    by = list(by)
    ks = range(len(probs))
    bounds = [f"__{e}{k}" for k in ks for e in ("lo", "hi")]
    x = F.col("__x")
    rows = _key_join(df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__x")), groups, by, bounds)
    inside = F.col("__lo0").isNull() | _any([(x >= F.col(f"__lo{k}")) & (x <= F.col(f"__hi{k}")) for k in ks])
    # rows between brackets count together, right after the bracket below them
    below = [F.when(F.col(f"__hi{k}") < x, F.col(f"__hi{k}")) for k in ks]
    below = F.greatest(*below) if len(below) > 1 else below[0]
    counts = (rows.select(*by, F.when(inside, x).otherwise(below).alias("__x"), (~inside).alias("__gap"))
              .groupBy(*by, "__x", "__gap").agg(F.count(F.lit(1)).alias("__c")))
    order = Window.partitionBy(*by).orderBy(F.col("__x").asc_nulls_first(), "__gap")
    counts = counts.withColumns({"__up": F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0)),
                                 "__n": F.sum("__c").over(Window.partitionBy(*by))})
    h = [(F.col("__n") - 1).cast("double") * F.lit(float(p)) + 1 for p in probs]
    ranks = [r for v in h for r in (F.floor(v).cast("long"), F.least(F.floor(v).cast("long") + 1, F.col("__n")))]
    at = [(r > F.col("__up") - F.col("__c")) & (r <= F.col("__up")) for r in ranks]
    picked = counts.filter(_any(at)).groupBy(*by, "__n").agg(
        *[F.max(F.when(c, F.struct(F.col("__x").alias("x"), F.col("__gap").alias("gap")))).alias(f"__r{k}") for k, c in enumerate(at)])

    def between(k: int, v: Column) -> Column:
        a, b = F.col(f"__r{2 * k}"), F.col(f"__r{2 * k + 1}")
        lost = a["gap"] | b["gap"]  # a bracket that misses its rank would be an error of the sketch
        q = F.when(a["x"] == b["x"], a["x"]).otherwise(a["x"] + (v - F.floor(v)) * (b["x"] - a["x"]))
        return F.when(lost, F.raise_error(F.lit("a quantile's bracket misses its rank")).cast("double")).otherwise(q)

    return picked.select(*by, "__n", *[between(k, v).alias(nm) for k, (v, nm) in enumerate(zip(h, names))])


def exact_quantiles(df: DataFrame, value: str, by: Sequence[str],
                    probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact type-7 quantiles per group (R ``quantile``/``median``):
    ``h = (n - 1) p + 1``, ``q = x_(floor h) + (h - floor h)(x_(floor h + 1) - x_(floor h))``.

    The input is read twice, at every size: one aggregate with a sketch of
    known error brackets the wanted ranks, one counts the values inside the
    brackets. Only those are ranked: 8 / ``ACCURACY`` of a large group's
    rows for each quantile. Rows are counted where they are read, so no task
    sorts or holds those of a large group. Infinities are values like
    others, NaN is above them; between two different neighbours
    floating-point arithmetic holds. NULL values are ignored; a group with
    no value is absent.
    """
    by = list(by)
    return _with_quantiles(df, value, by, [], [], probs, names).filter(F.col("__n") > 0).drop("__n")


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def stats_exprs(col: str | Column) -> list[Column]:
    """n, min, max, mean, sd with ``na.rm=TRUE`` (n counts rows); the median
    is added by ``summarise_stats``."""
    c = F.col(col) if isinstance(col, str) else col
    return [F.count(F.lit(1)).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"),
            F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")]


def summarise_stats(df: DataFrame, by: Sequence[str], col: str,
                    exact_median: bool = True, accuracy: int = 100000) -> DataFrame:
    """n, min, max, mean, sd, median per group (``summarise`` with
    ``na.rm=TRUE``; n counts all rows, the rest drop NULLs).

    The exact median comes from ``exact_quantiles``; with
    ``exact_median=False`` it is the bounded-memory ``percentile_approx``.
    """
    by = list(by)
    if not exact_median:
        return df.groupBy(*by).agg(*stats_exprs(col), F.percentile_approx(
            col, 0.5, accuracy).cast("double").alias("median"))
    return _with_median(df, col, by, stats_exprs(col), ["n", "min", "max", "mean", "sd"])


def median_min_max(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """``summarise(median, min, max)`` with ``na.rm=TRUE`` (exact median)."""
    return _with_median(df, col, list(by), [F.min(col).alias("min"), F.max(col).alias("max")], ["min", "max"])


def _with_median(df: DataFrame, col: str, by: list[str], more: Sequence[Column], names: Sequence[str]) -> DataFrame:
    return _with_quantiles(df, col, by, more, names, [0.5], ["median"]).drop("__n")


def _with_quantiles(df: DataFrame, value: str, by: list[str], more: Sequence[Column], more_names: Sequence[str],
                    probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """(by..., __n, more_names..., names...), one row per group; groups
    without a value stay, with NULL quantiles."""
    base = _sketched(df, value, by, probs, more)
    q = _ranked(df, value, by, base, probs, names).drop("__n")
    if by:
        return _join_by_keys(base.select(*by, "__n", *more_names), q, by, "left")
    one = q.select(F.struct(*names).alias("s")).scalar()
    return base.withColumn("__one", one).select("__n", *more_names, *[F.col("__one")[c].alias(c) for c in names])


def _join_by_keys(big: DataFrame, small: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group keys, NULL-safe (a NULL group is a group)."""
    sm = small.withColumnsRenamed({c: f"__k_{c}" for c in by})
    cond = None
    for c in by:
        e = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        cond = e if cond is None else cond & e
    return big.join(sm, cond, how).drop(*[f"__k_{c}" for c in by])


def first_last(df: DataFrame, by: Sequence[str], ts: str,
               units: str = "hours") -> DataFrame:
    """First and last instant per group and the span between them.

    ``arrange(ts) %>% summarise(first(ts), last(ts))`` equals min/max.
    """
    from smolt.functions.scalars import timediff
    g = df.groupBy(*by).agg(F.min(ts).alias("first_det"), F.max(ts).alias("last_det"))
    return g.withColumn("duration", timediff("last_det", "first_det", units))


def having_count(df: DataFrame, by: Sequence[str], min_exclusive: int = 1,
                 out: str = "n") -> DataFrame:
    """``summarise(n = n()) %>% filter(n > k)``."""
    return count_rows(df, by, out).filter(F.col(out) > min_exclusive)


def nonnull_count(df: DataFrame, by: Sequence[str], col: str, out: str = "n") -> DataFrame:
    """``filter(!is.na(x)) %>% summarise(n = n())``: groups with no value vanish."""
    return df.filter(F.col(col).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def pivot_agg(df: DataFrame, by: Sequence[str], pivot_col: str, values: Sequence,
              agg: Column) -> DataFrame:
    """``summarise(...) %>% spread(k, v)``: the pivot value list is explicit
    (no extra job to discover it, stable columns); missing cells are NULL."""
    return df.groupBy(*by).pivot(pivot_col, list(values)).agg(agg)
