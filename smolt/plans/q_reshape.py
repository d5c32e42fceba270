"""Set operations and reshaping (survey 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from smolt.functions.nullsafe import isin_safe
from smolt.operators import reshape as R
from smolt.plans.registry import query
from smolt.plans.sqlparts import DET, OCC, REL
from smolt.sources import tables as T

YEARS = T.OCCASIONS
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


@query("union_fill", f"""
SELECT tag, ts, site, NULL AS receiver FROM ({DET})
UNION ALL SELECT tag, release_ts AS ts, NULL AS site, 'release' AS receiver FROM ({REL})""")
def union_fill(spark, d):
    det = T.detections(spark, d).select("tag", "ts", "site")
    rel = T.releases(spark, d).select("tag", F.col("release_ts").alias("ts"),
                                      F.lit("release").alias("receiver"))
    return R.union_fill(det, rel)


@query("union_strict", f"""
SELECT tag, ts, site FROM ({DET}) WHERE site IN ('signup', 'view')
UNION ALL SELECT tag, ts, site FROM ({DET}) WHERE site NOT IN ('signup', 'view')""")
def union_strict(spark, d):
    det = T.detections(spark, d).select("tag", "ts", "site")
    local = isin_safe("site", ["signup", "view"])
    return R.union_strict(det.filter(local), det.filter(~local))


@query("add_release_rows", f"""
SELECT tag, ts, site, 'detection' AS type FROM ({DET})
UNION ALL SELECT tag, release_ts AS ts, 'release' AS site, 'release' AS type FROM ({REL})""")
def add_release_rows(spark, d):
    det = T.detections(spark, d).select("tag", "ts", "site").withColumn("type", F.lit("detection"))
    return R.add_event_rows(det, T.releases(spark, d), "tag", "ts", "release_ts",
                            {"site": "release", "type": "release"})


@query("unpivot_injuries", """
SELECT l_orderkey, l_linenumber, l_returnflag, injury, value FROM lineitem
UNPIVOT (value FOR injury IN (l_quantity, l_discount, l_tax))""")
def unpivot_injuries(spark, d):
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag",
                                              "l_quantity", "l_discount", "l_tax")
    return R.unpivot_long(li, ["l_orderkey", "l_linenumber", "l_returnflag"], key="injury")


def monthly_wide(spark, d):
    """Daily series, wide by month: (YEAR, DD, Jan..Dec) = total order value
    of that calendar day (NULL where no order; impossible dates absent)."""
    o = T.table(spark, d, "orders").select(
        F.year("o_orderdate").alias("YEAR"), F.dayofmonth("o_orderdate").alias("DD"),
        F.month("o_orderdate").alias("m"), "o_totalprice")
    w = o.groupBy("YEAR", "DD").pivot("m", list(range(1, 13))).agg(F.round(F.sum("o_totalprice"), 2))
    return w.withColumnsRenamed({str(i + 1): m for i, m in enumerate(MONTHS)})


WIDE_SQL = ("SELECT CAST(year(o_orderdate) AS INTEGER) AS \"YEAR\", CAST(day(o_orderdate) AS INTEGER) AS DD, "
            + ", ".join(f"round(sum(CASE WHEN month(o_orderdate) = {i + 1} THEN o_totalprice END), 2) AS {m}"
                        for i, m in enumerate(MONTHS))
            + " FROM orders GROUP BY 1, 2")


@query("unpivot_months", f"""
SELECT "YEAR", DD, month, discharge FROM ({WIDE_SQL}) UNPIVOT (discharge FOR month IN ({', '.join(MONTHS)}))""")
def unpivot_months(spark, d):
    return R.unpivot_long(monthly_wide(spark, d), ["YEAR", "DD"], key="month", value="discharge",
                          drop_nulls=True)


@query("pivot_wide", """
SELECT l_returnflag, CAST(NULLIF(count(CASE WHEN l_linestatus = 'F' THEN 1 END), 0) AS BIGINT) AS F,
       CAST(NULLIF(count(CASE WHEN l_linestatus = 'O' THEN 1 END), 0) AS BIGINT) AS O FROM lineitem GROUP BY l_returnflag""")
def pivot_wide(spark, d):
    # flags A and R have no open lines: those cells stay NULL
    li = T.table(spark, d, "lineitem")
    c = li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.first("n"))


IND_SQL = (f"SELECT tag, grp, "
           + ", ".join(f"CAST(max(CASE WHEN year = {y} THEN 1 ELSE 0 END) AS INTEGER) AS y_{y}" for y in YEARS)
           + f" FROM ({OCC}) GROUP BY tag, grp")


@query("pivot_indicator", IND_SQL)
def pivot_indicator(spark, d):
    o = T.occasions_table(spark, d)
    return R.pivot_indicator(o, ["tag", "grp"], "year", YEARS, prefix="y_")


@query("unite_columns", f"SELECT tag, grp, {' || '.join(f'CAST(y_{y} AS VARCHAR)' for y in YEARS)} AS ch FROM ({IND_SQL})")
def unite_columns(spark, d):
    w = pivot_indicator(spark, d)
    return R.unite(w, "ch", [f"y_{y}" for y in YEARS], sep="")
