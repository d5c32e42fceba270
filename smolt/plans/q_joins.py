"""Joins (survey 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from smolt.operators import joins as J
from smolt.operators import windows as W
from smolt.plans.common import rounded
from smolt.plans.registry import query
from smolt.plans.sqlparts import DET, REL, SITES, TAGS
from smolt.sources import tables as T


@query("join_inner", """
SELECT o.o_orderkey, o.o_custkey, c.c_mktsegment, o.o_totalprice
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def join_inner(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return o.join(c, "o_custkey", "inner")


@query("join_inner_dim", f"SELECT d.tag, d.site, d.ts, d.tie, s.rkm FROM ({DET}) d JOIN ({SITES}) s ON d.site = s.site")
def join_inner_dim(spark, d):
    det = T.detections(spark, d).select("tag", "site", "ts", "tie")
    return J.join_dim(det, T.sites(spark), "site")


@query("join_composite_string_key", """
WITH g AS (SELECT c_nationkey, c_mktsegment, CAST(count(*) AS BIGINT) AS n_in_group, avg(c_acctbal) AS avg_acct
           FROM customer GROUP BY c_nationkey, c_mktsegment)
SELECT c.c_custkey, c.c_nationkey, c.c_mktsegment, g.n_in_group, round(g.avg_acct, 6) AS avg_acct
FROM customer c JOIN g ON c.c_nationkey = g.c_nationkey AND c.c_mktsegment = g.c_mktsegment""")
def join_composite_string_key(spark, d):
    c = T.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    keys = ["c_nationkey", "c_mktsegment"]
    g = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_in_group"), F.avg("c_acctbal").alias("avg_acct"))
    # two-column equi-join; no concatenated key needed
    out = c.drop("c_acctbal").join(g, keys, "inner")
    return rounded(out, ["avg_acct"])


@query("join_full_outer", """
WITH f AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(count(*) AS BIGINT) AS n_f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
     o AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(count(*) AS BIGINT) AS n_o FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2)
SELECT coalesce(f.o_custkey, o.o_custkey) AS o_custkey, coalesce(f.yr, o.yr) AS yr, f.n_f, o.n_o
FROM f FULL OUTER JOIN o ON f.o_custkey = o.o_custkey AND f.yr = o.yr""")
def join_full_outer(spark, d):
    o = T.table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("yr"),
                                           "o_orderstatus")
    f = o.filter(F.col("o_orderstatus") == "F").groupBy("o_custkey", "yr").agg(
        F.count(F.lit(1)).alias("n_f"))
    op = o.filter(F.col("o_orderstatus") == "O").groupBy("o_custkey", "yr").agg(
        F.count(F.lit(1)).alias("n_o"))
    return J.full_join(f, op, ["o_custkey", "yr"])


@query("join_suffixes", f"""
WITH a AS (SELECT tag, min(ts) AS ts FROM ({DET}) WHERE site = 'signup' GROUP BY tag),
     b AS (SELECT tag, min(ts) AS ts FROM ({DET}) WHERE site = 'purchase' GROUP BY tag)
SELECT a.tag, a.ts AS ts_x, b.ts AS ts_y,
       round(CAST(epoch_us(b.ts) - epoch_us(a.ts) AS DOUBLE) / 60e6, 6) AS time_diff
FROM a JOIN b ON a.tag = b.tag""")
def join_suffixes(spark, d):
    det = T.detections(spark, d)
    a = det.filter(F.col("site") == "signup").groupBy("tag").agg(F.min("ts").alias("ts"))
    b = det.filter(F.col("site") == "purchase").groupBy("tag").agg(F.min("ts").alias("ts"))
    j = J.join_suffixed(a, b, ["tag"])
    from smolt.functions.scalars import timediff
    return rounded(j.withColumn("time_diff", timediff("ts_y", "ts_x", "mins")), ["time_diff"])


@query("semi_join", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def semi_join(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = T.table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING") \
        .select(F.col("c_custkey").alias("o_custkey"))
    return J.semi_join(o, c, "o_custkey")


@query("anti_join", f"""
SELECT tag, tie FROM ({DET}) d
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_mktsegment = 'MACHINERY' AND c.c_custkey IS NOT DISTINCT FROM d.tag)""")
def anti_join(spark, d):
    det = T.detections(spark, d).select("tag", "tie")
    mach = T.tags(spark, d).filter(F.col("release_group") == "MACHINERY").select("tag")
    return J.anti_join_keep_null(det, mach, "tag")


@query("exists_flag", f"""
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT tag FROM ({DET}) WHERE value > 95) THEN 'Yes' ELSE 'No' END AS sensor
FROM customer""")
def exists_flag(spark, d):
    c = T.table(spark, d, "customer").select("c_custkey")
    hot = T.detections(spark, d).filter(F.col("value") > 95).select(F.col("tag").alias("c_custkey"))
    return J.exists_flag(c, hot, "c_custkey", "sensor")


@query("join_temporal_filter", f"""
SELECT d.tag, d.tie, d.ts, r.release_ts FROM ({DET}) d JOIN ({REL}) r ON d.tag = r.tag WHERE d.ts > r.release_ts""")
def join_temporal_filter(spark, d):
    det = T.detections(spark, d).select("tag", "tie", "ts")
    return J.join_after(det, T.releases(spark, d), "tag", "ts", "release_ts")


@query("join_back_to_agg", f"""
SELECT a.tag, a.n, t.release_group FROM (SELECT tag, CAST(count(*) AS BIGINT) AS n FROM ({DET}) GROUP BY tag) a
JOIN ({TAGS}) t ON a.tag = t.tag""")
def join_back_to_agg(spark, d):
    det = T.detections(spark, d)
    return J.join_back_to_agg(det, ["tag"], {"n": F.count(F.lit(1))}, T.tags(spark, d), "tag")


@query("join_first_event", f"""
WITH p AS (SELECT tag, ts AS first_ts, row_number() OVER (PARTITION BY tag ORDER BY ts, tie) AS rn FROM ({DET}) WHERE site = 'purchase')
SELECT p.tag, p.first_ts, r.release_ts,
       round(CAST(epoch_us(p.first_ts) - epoch_us(r.release_ts) AS DOUBLE) / 3600e6, 6) AS time_to_pass
FROM p JOIN ({REL}) r ON p.tag = r.tag WHERE p.rn = 1""")
def join_first_event(spark, d):
    det = T.detections(spark, d).filter(F.col("site") == "purchase").select("tag", "ts", "tie")
    first = W.first_per_group(det, ["tag"], "ts", "tie").select("tag", F.col("ts").alias("first_ts"))
    out = J.elapsed_since(first, T.releases(spark, d), "tag", "first_ts", "release_ts",
                          "time_to_pass", "hours")
    return rounded(out, ["time_to_pass"])


@query("dup_key_report", """
SELECT o_custkey AS tag, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1""")
def dup_key_report(spark, d):
    """Ids with more than one release: a join on them fans out."""
    return J.dup_key_report(T.table(spark, d, "orders").select(F.col("o_custkey").alias("tag")), "tag")


BEST_SQL = """
SELECT o.o_custkey AS tag, l.l_orderkey, l.l_linenumber, l.l_shipdate AS sample_ts, r.o_orderkey AS release_id, r.o_orderdate AS release_ts,
       r.o_orderpriority AS treatment
FROM (SELECT *, row_number() OVER () AS rid FROM lineitem) l JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN orders r ON r.o_custkey = o.o_custkey AND r.o_orderdate <= l.l_shipdate
QUALIFY row_number() OVER (PARTITION BY l.rid ORDER BY r.o_orderdate DESC NULLS LAST, r.o_orderpriority, r.o_orderkey) = 1"""


def repeated_ids(spark, d):
    """Samples and releases whose id repeats: line items by their customer,
    and the customer's orders."""
    o = T.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("tag"), F.col("o_orderdate").alias("release_ts"),
                                           F.col("o_orderpriority").alias("treatment"))
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("sample_ts"))
    samples = li.join(o.select("o_orderkey", "tag"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    return samples, o.withColumnRenamed("o_orderkey", "release_id")


@query("join_last_before", BEST_SQL)
def join_last_before(spark, d):
    """The last release of a sample's id at or before the sample."""
    samples, releases = repeated_ids(spark, d)
    return J.last_before(samples, releases, "tag", "sample_ts", "release_ts", ["treatment", "release_id"])
