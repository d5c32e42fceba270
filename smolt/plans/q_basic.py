"""Projection, column shaping and filters (survey 2.2, 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from smolt.functions.nullsafe import isin_safe
from smolt.functions.scalars import null_tokens
from smolt.operators import filters as Fl
from smolt.operators import movement as M
from smolt.plans.common import rounded
from smolt.plans.registry import query
from smolt.plans.sqlparts import DET
from smolt.sources import tables as T


def _site_or_null(spark, d):
    """Detections whose site is unreadable (value > 90) carry a NULL site."""
    return T.detections(spark, d).withColumn(
        "site_n", F.when(F.col("value") > 90, F.lit(None)).otherwise(F.col("site")))


SITE_N = f"SELECT *, CASE WHEN value > 90 THEN NULL ELSE site END AS site_n FROM ({DET})"


@query("select_cols", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def select_cols(spark, d):
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                                "l_returnflag")


@query("drop_cols", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def drop_cols(spark, d):
    return T.table(spark, d, "orders").drop("o_orderpriority", "o_orderstatus")


@query("rename_cols", "SELECT c_custkey AS tag_id, c_mktsegment AS release_group, c_nationkey FROM customer")
def rename_cols(spark, d):
    c = T.table(spark, d, "customer").withColumnsRenamed(
        {"c_custkey": "tag_id", "c_mktsegment": "release_group"})
    return c.select("tag_id", "release_group", "c_nationkey")


@query("derive_cols", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS disc_price,
       round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem""")
def derive_cols(spark, d):
    li = T.table(spark, d, "lineitem")
    # the second column uses the first, as inside one R ``mutate``
    x = li.withColumn("disc_price", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    x = x.withColumn("charge", F.col("disc_price") * (1 + F.col("l_tax")))
    return rounded(x.select("l_orderkey", "l_linenumber", "disc_price", "charge"),
                   ["disc_price", "charge"])


@query("reorder_cols", "SELECT l_returnflag, l_orderkey, l_linenumber, l_quantity FROM lineitem")
def reorder_cols(spark, d):
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                              "l_returnflag")
    cols = li.columns
    cols.remove("l_returnflag")
    at = cols.index("l_orderkey")
    return li.select(*cols[:at], "l_returnflag", *cols[at:])


@query("lit_cols", f"""
SELECT tag, ts, tie, 'detection' AS type, 'fraser' AS site_label, CAST(1 AS INTEGER) AS dummy_var
FROM ({DET})""")
def lit_cols(spark, d):
    return T.detections(spark, d).select(
        "tag", "ts", "tie", F.lit("detection").alias("type"), F.lit("fraser").alias("site_label"),
        F.lit(1).alias("dummy_var"))


@query("cast_cols", """
SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nation_txt,
       TRY_CAST(substring(c_name, 10) AS BIGINT) AS name_num,
       TRY_CAST(c_mktsegment AS DOUBLE) AS segment_num,
       c_mktsegment AS segment FROM customer""")
def cast_cols(spark, d):
    c = T.table(spark, d, "customer")
    return c.select("c_custkey", F.col("c_nationkey").cast("string").alias("nation_txt"),
                    F.substring("c_name", 10, 1 << 20).try_cast("bigint").alias("name_num"),
                    F.col("c_mktsegment").try_cast("double").alias("segment_num"),
                    F.col("c_mktsegment").cast("string").alias("segment"))


@query("null_tokens", """
SELECT l_orderkey, l_linenumber,
       TRY_CAST(CASE WHEN l_linenumber = 1 THEN 'na' WHEN l_linenumber = 2 THEN ' '
                     WHEN l_linenumber = 3 THEN 'NA' ELSE CAST(l_linenumber * 10 AS VARCHAR) END AS DOUBLE) AS qty
FROM lineitem""")
def null_tokens_q(spark, d):
    li = T.table(spark, d, "lineitem")
    raw = (F.when(F.col("l_linenumber") == 1, F.lit("na"))
            .when(F.col("l_linenumber") == 2, F.lit(" "))
            .when(F.col("l_linenumber") == 3, F.lit("NA"))
            .otherwise((F.col("l_linenumber") * 10).cast("string")))
    return li.select("l_orderkey", "l_linenumber", null_tokens(raw).try_cast("double").alias("qty"))


@query("filter_compare", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem
WHERE l_quantity >= 45 AND l_discount <> 0.05 AND l_tax < 0.08 AND l_extendedprice > 1000""")
def filter_compare(spark, d):
    li = T.table(spark, d, "lineitem")
    c = ((F.col("l_quantity") >= 45) & (F.col("l_discount") != 0.05) & (F.col("l_tax") < 0.08)
         & (F.col("l_extendedprice") > 1000))
    return Fl.filter_expr(li, c).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount",
                                        "l_tax")


@query("filter_in_set", f"SELECT tag, site, ts, tie FROM ({DET}) WHERE site IN ('click', 'view')")
def filter_in_set(spark, d):
    return Fl.filter_in(T.detections(spark, d), "site", ["click", "view"]).select(
        "tag", "site", "ts", "tie")


@query("filter_not_in_set", f"""
SELECT tag, site_n, ts, tie FROM ({SITE_N}) WHERE site_n IS NULL OR site_n NOT IN ('click')""")
def filter_not_in_set(spark, d):
    return Fl.filter_not_in(_site_or_null(spark, d), "site_n", ["click"]).select(
        "tag", "site_n", "ts", "tie")


@query("filter_null", f"SELECT tag, ts, tie, value FROM ({SITE_N}) WHERE site_n IS NULL")
def filter_null(spark, d):
    return Fl.keep_na(_site_or_null(spark, d), "site_n").select("tag", "ts", "tie", "value")


@query("filter_compound", f"""
SELECT tag, site, ts, tie, value FROM ({DET})
WHERE (site IN ('click', 'purchase') AND value >= 50) OR (site = 'error' AND NOT (value < 10))""")
def filter_compound(spark, d):
    det = T.detections(spark, d)
    c = ((isin_safe("site", ["click", "purchase"]) & (F.col("value") >= 50))
         | ((F.col("site") == "error") & ~(F.col("value") < 10)))
    return det.filter(c).select("tag", "site", "ts", "tie", "value")


@query("filter_on_lag", f"""
WITH g AS (SELECT tag, ts, tie, CAST(epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY tag ORDER BY ts, tie)) AS DOUBLE) / 1e6 AS gap FROM ({DET}))
SELECT tag, ts, tie, round(gap, 6) AS gap FROM g WHERE gap >= 45""")
def filter_on_lag(spark, d):
    det = T.detections(spark, d).select("tag", "ts", "tie")
    g = M.lag_timediff(det, out="gap")
    return rounded(g.filter(F.col("gap") >= 45), ["gap"])


DENY = [("signup", "purchase"), ("view", "error"), ("click", "signup")]


@query("deny_pairs", f"""
WITH t AS (SELECT tag, site, ts, tie, LAG(site) OVER (PARTITION BY tag ORDER BY ts, tie) AS prev_site FROM ({DET}))
SELECT tag, ts, tie, prev_site, site FROM t
WHERE NOT coalesce((prev_site = 'signup' AND site = 'purchase') OR (prev_site = 'view' AND site = 'error')
                   OR (prev_site = 'click' AND site = 'signup'), false)""")
def deny_pairs(spark, d):
    det = T.detections(spark, d).select("tag", "site", "ts", "tie")
    t = M.transitions(det)
    return Fl.deny_pairs(t, "prev_site", "site", DENY).select("tag", "ts", "tie", "prev_site", "site")
