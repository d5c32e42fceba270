"""Sort, limit and paging (survey 2.7)."""

from __future__ import annotations

from smolt.operators import aggregates as A
from smolt.operators import joins as J
from smolt.operators import sorting as So
from smolt.plans.common import rounded
from smolt.plans.registry import query
from smolt.plans.sqlparts import DET, SITES
from smolt.sources import tables as T

# Fixed values of the binding: river order, downstream end first (the
# reference declares its factor levels in this direction).
RIVER_ORDER = ["error", "purchase", "click", "view", "signup", "release"]


@query("sort_multi", f"SELECT tag, ts, tie, site FROM ({DET}) ORDER BY tag, ts, tie")
def sort_multi(spark, d):
    det = T.detections(spark, d).select("tag", "ts", "tie", "site")
    return So.sort_nulls_last(det, ["tag", "ts", "tie"])


@query("sort_desc_in_group", f"""
SELECT d.tag, s.rkm, min(d.ts) AS first_det, max(d.ts) AS last_det,
       round(CAST(epoch_us(max(d.ts)) - epoch_us(min(d.ts)) AS DOUBLE) / 3600e6, 6) AS duration
FROM ({DET}) d JOIN ({SITES}) s ON d.site = s.site GROUP BY d.tag, s.rkm ORDER BY d.tag, s.rkm DESC""")
def sort_desc_in_group(spark, d):
    x = J.join_dim(T.detections(spark, d), T.sites(spark), "site")
    fl = rounded(A.first_last(x, ["tag", "rkm"], "ts", "hours"), ["duration"])
    return So.sort_nulls_last(fl, ["tag", "rkm"], descending=["rkm"])


@query("sort_custom_rank", f"""
SELECT tag, site, ts, tie, CAST(CASE site {' '.join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(RIVER_ORDER))} ELSE {len(RIVER_ORDER) + 1} END AS INTEGER) AS site_rank
FROM ({DET}) ORDER BY site_rank, ts, tie""")
def sort_custom_rank(spark, d):
    det = T.detections(spark, d).select("tag", "site", "ts", "tie")
    r = det.withColumn("site_rank", So.rank_column("site", RIVER_ORDER, "site_rank"))
    return So.sort_nulls_last(r, ["site_rank", "ts", "tie"])


@query("head_limit", f"SELECT tag, site, ts, tie FROM ({DET}) ORDER BY ts, tie LIMIT 6")
def head_limit(spark, d):
    det = T.detections(spark, d).select("tag", "site", "ts", "tie")
    # a top-k: Spark plans TakeOrderedAndProject (per-task top 6, then merge)
    return So.sort_nulls_last(det, ["ts", "tie"]).limit(6)


@query("page_assign", f"""
SELECT tag, CAST(row_number() OVER (ORDER BY tag) AS BIGINT) AS key_rank,
       CAST(ceil(row_number() OVER (ORDER BY tag) / 16.0) AS BIGINT) AS page
FROM (SELECT DISTINCT tag FROM ({DET}))""")
def page_assign(spark, d):
    return So.page_assign(T.detections(spark, d), "tag", 16)
