"""Encounter histories and their sufficient statistics (survey 2.11).

A history is a fixed-length 0/1 string per tag over an explicit, ordered
occasion list. It is built as an aggregate: the set of a tag's occasions holds at
most K numbers, so a tag with millions of detections costs one small set
per input task before the shuffle, and K has no limit. Everything downstream works on
the frequency table (history x group -> count), whose size is bounded by
``2**K * groups`` whatever the number of animals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def history_string(occasions: Column, k: int) -> Column:
    """Render a set of 0-based occasions as a K-digit 0/1 string."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                         lambda i: F.when(F.array_contains(occasions, i), F.lit("1")).otherwise(F.lit("0")))
    return F.array_join(digits, "")


def encounter_history(sightings: DataFrame, tag: str, group: str, occ: str, k: int,
                      min_count: int = 1) -> DataFrame:
    """(tag, group, ch) from sightings with a 0-based occasion index.

    ``min_count`` > 1 marks an occasion only when the tag was seen there at
    least that many times (the "no single detections" table); tags left
    with no occasion vanish, as in the reference. A NULL occasion is no
    sighting. An occasion outside ``[0, k)`` is not in the declared list
    and raises an error when the rows are computed.
    """
    o = F.col(occ)
    known = F.when((o >= 0) & (o < k), o.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit(f"occasion outside 0..{k - 1}: "), o.cast("string"))).cast("int"))
    s = sightings.filter(o.isNotNull()).withColumn(occ, known)
    if min_count > 1:
        s = (s.groupBy(tag, group, occ).agg(F.count(F.lit(1)).alias("__n"))
              .filter(F.col("__n") >= min_count))
    seen = s.groupBy(tag, group).agg(F.collect_set(occ).alias("__occ"))
    return seen.select(tag, group, history_string(F.col("__occ"), k).alias("ch"))


def history_frequency(hist: DataFrame, group: str, extra: Sequence[str] = ()) -> DataFrame:
    """Unique history x group counts (``process.data``)."""
    return hist.groupBy(*extra, "ch", group).agg(F.count(F.lit(1)).alias("n"))


def history_wide(freq: DataFrame, group: str, levels: Sequence[str],
                 extra: Sequence[str] = ()) -> DataFrame:
    """One row per history, one count column per group (0 when absent)."""
    w = freq.groupBy(*extra, "ch").pivot(group, list(levels)).agg(F.sum("n"))
    w = w.fillna(0, subset=[str(v) for v in levels])
    return w.select(*extra, "ch", *[F.col(str(v)).cast("long").alias(f"n_{v}") for v in levels])


def _positions(ch: Column, k: int) -> Column:
    """1-based occasions holding a '1'."""
    return F.filter(F.sequence(F.lit(1), F.lit(k)),
                    lambda i: F.substring(ch, i, 1) == F.lit("1"))


def m_array(freq: DataFrame, group: str, k: int, extra: Sequence[str] = ()) -> DataFrame:
    """Releases and next recaptures: (group, release_occ, recapture_occ, n).

    Every capture at occasion i < K is a release; ``recapture_occ`` is the
    next occasion with a capture, NULL when never seen again. R_i is the
    sum over recapture occasions including NULL.
    """
    pos = _positions(F.col("ch"), k)
    pairs = F.transform(pos, lambda p, j: F.struct(
        p.alias("release_occ"), F.try_element_at(pos, j + 2).alias("recapture_occ")))
    x = freq.select(*extra, group, "n", F.explode(pairs).alias("__p"))
    x = x.filter(F.col("__p.release_occ") < k)
    return (x.groupBy(*extra, group, F.col("__p.release_occ").alias("release_occ"),
                      F.col("__p.recapture_occ").alias("recapture_occ"))
             .agg(F.sum("n").cast("long").alias("n")))


def first_last_occ(ch: Column, k: int) -> tuple[Column, Column]:
    """1-based first and last occasion with a capture."""
    first = F.instr(ch, "1")
    last = F.lit(k + 1) - F.instr(F.reverse(ch), "1")
    return first, last


def effective_sample_size(freq: DataFrame, k: int, extra: Sequence[str] = ()) -> DataFrame:
    """Sum over animals of captures before the last occasion."""
    ones = F.length(F.regexp_replace(F.substring(F.col("ch"), 1, k - 1), "0", ""))
    return freq.groupBy(*extra).agg(F.sum(ones * F.col("n")).cast("long").alias("ess"))


def saturated_neg2lnl(freq: DataFrame, group: str, k: int,
                      extra: Sequence[str] = ()) -> DataFrame:
    """-2 ln L of the saturated model: -2 sum n ln(n / N_cohort), the
    cohort being (group, first capture occasion)."""
    first, _ = first_last_occ(F.col("ch"), k)
    c = freq.withColumn("__f", first)
    tot = c.groupBy(*extra, group, "__f").agg(F.sum("n").alias("__N"))
    j = c.join(tot, [*extra, group, "__f"])
    return j.groupBy(*extra).agg(
        (F.lit(-2.0) * F.sum(F.col("n") * F.log(F.col("n") / F.col("__N")))).alias("neg2lnl_sat"))


def cohorts(freq: DataFrame, group: str, k: int, extra: Sequence[str] = ()) -> DataFrame:
    """(group, first occasion, N) of every non-empty release cohort."""
    first, _ = first_last_occ(F.col("ch"), k)
    return (freq.withColumn("first_occ", first)
                .groupBy(*extra, group, "first_occ").agg(F.sum("n").cast("long").alias("N")))


def closed_form_time(freq: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Time-dependent Phi(t) p(t) moment estimates from the m-array
    (Jolly's method): ``M_j = m_j + R_j z_j / r_j``,
    ``Phi_j = M_{j+1} / (M_j - m_j + R_j)``, ``p_j = m_j / M_j``.

    Unbounded (a Phi above 1 is reported as is); the last Phi and p are
    confounded and only their product ``r_{K-1} / R_{K-1}`` is given.
    All inputs are aggregates of the frequency table; the per-occasion
    table has K - 1 rows per ``by`` group.
    """
    from pyspark.sql import Window
    by = list(by)
    # one explode over occasions 1..K-1 and one aggregate: for occasion j,
    # released = captured at j; recaptured = captured at j and later;
    # marked = captured at j after the first capture; between = missed at j
    # but seen before and after
    first, last = first_last_occ(F.col("ch"), k)
    x = freq.select(*by, "n", first.alias("__f"), last.alias("__l"), "ch",
                    F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("occ"))
    hit = F.substring(F.col("ch"), F.col("occ"), 1) == F.lit("1")
    cnt = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0))).cast("long")
    t = x.groupBy(*by, "occ").agg(
        cnt(hit).alias("released"),
        cnt(hit & (F.col("occ") < F.col("__l"))).alias("recaptured"),
        cnt(hit & (F.col("occ") > F.col("__f"))).alias("marked"),
        cnt(~hit & (F.col("occ") > F.col("__f")) & (F.col("occ") < F.col("__l"))).alias("between"))
    cnt_cols = ["released", "recaptured", "marked", "between"]
    R, r, m = F.col("released"), F.col("recaptured"), F.col("marked")
    dv = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))  # noqa: E731 (x/0 -> NULL)
    t = t.withColumn("marked_pop", m + dv(R * F.col("between"), r))
    M = F.col("marked_pop")
    w = Window.partitionBy(*by).orderBy("occ") if by else Window.orderBy("occ")
    phi = dv(F.lead("marked_pop").over(w), M - m + R)
    t = t.withColumn("phi", F.when(F.col("occ") < k - 1, phi))
    t = t.withColumn("p", F.when(F.col("occ") >= 2, dv(m, M)))
    t = t.withColumn("last_product", F.when(F.col("occ") == k - 1, dv(r, R)))
    return t.select(*by, "occ", *cnt_cols, "marked_pop", "phi", "p", "last_product")
