"""Bindings of the driver's parquet tables to the telemetry data model.

The driver tables are a generic star schema; the survey (2.14) binds them:

* detections  <- ``events``: ``user_id`` = tag, ``event_type`` = receiver
  site, ``ts`` = detection instant, ``event_id`` = tie-break, ``value`` =
  sensor reading.
* tag metadata <- ``customer``: ``c_custkey`` = tag, ``c_mktsegment`` =
  release group; release instant = the tag's first ``signup`` detection.
* encounter histories <- ``orders``: ``o_custkey`` = tag, year of
  ``o_orderdate`` = occasion, ``c_mktsegment`` = group.

Only the columns an operator needs are selected, so the parquet scan is
pruned (``ReadSchema``) and filters reach it (``PushedFilters``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of this binding: river kilometre of each event type acting
# as a receiver site, upstream (release end) first.
SITE_RKM = [
    ("signup", 110.2),
    ("view", 110.1),
    ("click", 67.0),
    ("purchase", 38.0),
    ("error", 23.0),
]
# Sites of the release reach (the reference's mountain-slough pair).
UPSTREAM_SITES = ("signup",)
DOWNSTREAM_SITES = ("view",)
RELEASE_SITE = "signup"

# Occasions of the ``orders`` histories: calendar years, in order.
FIRST_YEAR, LAST_YEAR = 1995, 2001
OCCASIONS = list(range(FIRST_YEAR, LAST_YEAR + 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag, site, ts, tie, value) — one row per detection."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("tag"), F.col("event_type").alias("site"),
        F.col("ts"), F.col("event_id").alias("tie"), F.col("value"))


def sites(spark: SparkSession) -> DataFrame:
    """Inline site -> rkm dimension: a literal relation, so its size is known
    to the planner and it is the broadcast side of every join."""
    rows = ", ".join(f"('{s}', {float(r)!r}D)" for s, r in SITE_RKM)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS sites(site, rkm)")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag, release_group) for every deployed tag."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("tag"), F.col("c_mktsegment").alias("release_group"))


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag, release_ts): first ``signup`` of each tag — an aggregate, so a
    hot tag is reduced map-side before the shuffle."""
    d = detections(spark, sf_dir).filter(F.col("site") == RELEASE_SITE)
    return d.groupBy("tag").agg(F.min("ts").alias("release_ts"))


def occasions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag, grp, occ, year) for every order, occ = 0-based occasion index."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    yr = F.year("o_orderdate")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .select(F.col("o_custkey").alias("tag"), F.col("c_mktsegment").alias("grp"),
                     (yr - F.lit(FIRST_YEAR)).alias("occ"), yr.alias("year")))
