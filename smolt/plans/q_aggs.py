"""Aggregations (survey 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from smolt.functions.nullsafe import sum_strict, not_in_safe
from smolt.operators import aggregates as A
from smolt.operators import movement as M
from smolt.plans.common import STATS, rounded, stats_sql
from smolt.plans.registry import query
from smolt.plans.sqlparts import DET, TAGS
from smolt.sources import tables as T

TAG_N = f"SELECT *, CASE WHEN value > 95 THEN NULL ELSE tag END AS tag_n FROM ({DET})"


def _tag_or_null(spark, d):
    """Detections with an unreadable transmitter code (value > 95): NULL tag."""
    return T.detections(spark, d).withColumn(
        "tag_n", F.when(F.col("value") > 95, F.lit(None)).otherwise(F.col("tag")))


@query("agg_count", f"SELECT site, CAST(count(*) AS BIGINT) AS n FROM ({DET}) GROUP BY site")
def agg_count(spark, d):
    return A.count_rows(T.detections(spark, d), ["site"])


@query("agg_count_global", "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
def agg_count_global(spark, d):
    return A.count_rows(T.table(spark, d, "lineitem"), [])


@query("agg_count_distinct", f"""
SELECT site, CAST(count(DISTINCT tag_n) + max(CASE WHEN tag_n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n
FROM ({TAG_N}) GROUP BY site""")
def agg_count_distinct(spark, d):
    return A.count_distinct(_tag_or_null(spark, d), ["site"], "tag_n")


@query("agg_count_distinct_global", f"SELECT CAST(count(DISTINCT tag) AS BIGINT) AS n_tags FROM ({DET})")
def agg_count_distinct_global(spark, d):
    return T.detections(spark, d).agg(F.count_distinct("tag").cast("long").alias("n_tags"))


@query("agg_sum", """
SELECT l_orderkey, round(CASE WHEN count(*) = count(q) THEN sum(q) END, 6) AS total
FROM (SELECT l_orderkey, CASE WHEN l_discount = 0.1 THEN NULL ELSE l_quantity END AS q FROM lineitem)
GROUP BY l_orderkey""")
def agg_sum(spark, d):
    li = T.table(spark, d, "lineitem").select(
        "l_orderkey", F.when(F.col("l_discount") == 0.1, F.lit(None)).otherwise(
            F.col("l_quantity")).alias("q"))
    return rounded(A.sum_by(li, ["l_orderkey"], "q", "total"), ["total"])


@query("agg_stats", f"SELECT l_returnflag, {stats_sql('l_extendedprice')} FROM lineitem GROUP BY l_returnflag")
def agg_stats(spark, d):
    li = T.table(spark, d, "lineitem")
    return rounded(A.summarise_stats(li, ["l_returnflag"], "l_extendedprice"), STATS)


@query("agg_stats_global", f"SELECT {stats_sql('o_totalprice')} FROM orders")
def agg_stats_global(spark, d):
    return rounded(A.summarise_stats(T.table(spark, d, "orders"), [], "o_totalprice"), STATS)


@query("agg_median_min_max", f"""
WITH fl AS (SELECT tag, site, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 3600e6 AS duration
            FROM ({DET}) GROUP BY tag, site)
SELECT site, round(quantile_cont(duration, 0.5), 6) AS median, round(min(duration), 6) AS min,
       round(max(duration), 6) AS max FROM fl GROUP BY site""")
def agg_median_min_max(spark, d):
    fl = A.first_last(T.detections(spark, d), ["tag", "site"], "ts", "hours")
    return rounded(A.median_min_max(fl, ["site"], "duration"), ["median", "min", "max"])


@query("agg_min_check", f"""
WITH g AS (SELECT tag, ts, tie, CAST(epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY tag ORDER BY ts, tie)) AS DOUBLE) / 1e6 AS gap FROM ({DET})),
k AS (SELECT tag, ts, tie FROM g WHERE gap >= 45),
r AS (SELECT CAST(epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY tag ORDER BY ts, tie)) AS DOUBLE) / 1e6 AS diff_time FROM k)
SELECT round(min(diff_time), 6) AS min_gap FROM r""")
def agg_min_check(spark, d):
    kept = M.gap_filter(T.detections(spark, d).select("tag", "ts", "tie"), 45.0)
    return rounded(kept.agg(F.min("diff_time").alias("min_gap")), ["min_gap"])


@query("agg_first_last", f"""
SELECT tag, site, min(ts) AS first_det, max(ts) AS last_det,
       round(CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 3600e6, 6) AS duration
FROM ({DET}) GROUP BY tag, site""")
def agg_first_last(spark, d):
    return rounded(A.first_last(T.detections(spark, d), ["tag", "site"], "ts", "hours"), ["duration"])


@query("agg_nonnull_label_count", f"""
SELECT site, CAST(count(*) AS BIGINT) AS n FROM ({TAG_N}) WHERE tag_n IS NOT NULL GROUP BY site""")
def agg_nonnull_label_count(spark, d):
    return A.nonnull_count(_tag_or_null(spark, d), ["site"], "tag_n")


@query("having_count", f"""
SELECT tag, CAST(count(*) AS BIGINT) AS n FROM ({DET}) WHERE value > 95 GROUP BY tag HAVING count(*) > 1""")
def having_count(spark, d):
    return A.having_count(T.detections(spark, d).filter(F.col("value") > 95), ["tag"], 1)


@query("distinct_values", f"SELECT DISTINCT site FROM ({DET})")
def distinct_values(spark, d):
    return T.detections(spark, d).select("site").distinct()


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("pivot_count_distinct", f"""
SELECT d.site, {', '.join(f"CAST(NULLIF(count(DISTINCT CASE WHEN t.release_group = '{s}' THEN d.tag END), 0) AS BIGINT) AS {s}" for s in SEGMENTS)}
FROM ({DET}) d JOIN ({TAGS}) t ON d.tag = t.tag GROUP BY d.site""")
def pivot_count_distinct(spark, d):
    """Distinct tags of all detections by site and release group."""
    return _distinct_tags(T.detections(spark, d).join(T.tags(spark, d), "tag"))


def _distinct_tags(j):
    """Distinct tags by site x release group; a cell without a tag is NULL, not 0."""
    p = A.pivot_agg(j, ["site"], "release_group", SEGMENTS, F.count_distinct("tag"))
    return p.select("site", *[F.when(F.col(s) > 0, F.col(s)).cast("long").alias(s) for s in SEGMENTS])


@query("pivot_sum", """
WITH l AS (SELECT l_orderkey, l_linestatus, NULLIF(l_quantity, 50) AS q FROM lineitem)
SELECT l_orderkey,
       round(CASE WHEN count(CASE WHEN l_linestatus = 'F' AND q IS NULL THEN 1 END) = 0 THEN sum(CASE WHEN l_linestatus = 'F' THEN q END) END, 6) AS F,
       round(CASE WHEN count(CASE WHEN l_linestatus = 'O' AND q IS NULL THEN 1 END) = 0 THEN sum(CASE WHEN l_linestatus = 'O' THEN q END) END, 6) AS O
FROM l GROUP BY l_orderkey""")
def pivot_sum(spark, d):
    # a NULL among the summed values makes the cell NULL (no na.rm)
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linestatus", F.nullif("l_quantity", F.lit(50.0)).alias("q"))
    return rounded(A.pivot_agg(li, ["l_orderkey"], "l_linestatus", ["F", "O"], sum_strict("q")), ["F", "O"])


@query("two_level_agg", f"""
WITH ts AS (SELECT tag, site, count(*) AS n FROM ({DET}) GROUP BY tag, site)
SELECT t.release_group, CAST(count(DISTINCT ts.tag) AS BIGINT) AS n_tags
FROM ts JOIN ({TAGS}) t ON ts.tag = t.tag WHERE ts.site NOT IN ('signup', 'view') GROUP BY t.release_group""")
def two_level_agg(spark, d):
    per = A.count_rows(T.detections(spark, d), ["tag", "site"])
    per = per.filter(not_in_safe("site", [*T.UPSTREAM_SITES, *T.DOWNSTREAM_SITES]))
    j = per.join(T.tags(spark, d), "tag")
    return A.count_distinct(j, ["release_group"], "tag", "n_tags", na_as_value=False)
