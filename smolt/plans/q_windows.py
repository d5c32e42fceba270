"""Window operators (survey 2.6) over the detections binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from smolt.functions import nullsafe as N
from smolt.operators import joins as J
from smolt.operators import movement as M
from smolt.operators import windows as W
from smolt.plans.common import rounded
from smolt.plans.registry import query
from smolt.plans.sqlparts import DET, SITES
from smolt.sources import tables as T

W_TAG = "OVER (PARTITION BY tag ORDER BY ts, tie)"
DETR = f"SELECT d.tag, d.site, d.ts, d.tie, s.rkm FROM ({DET}) d JOIN ({SITES}) s ON d.site = s.site"


def _det_rkm(spark, d):
    det = T.detections(spark, d).select("tag", "site", "ts", "tie")
    return J.join_dim(det, T.sites(spark), "site")


@query("win_lag_timediff", f"""
SELECT tag, ts, tie, round(CAST(epoch_us(ts) - epoch_us(LAG(ts) {W_TAG}) AS DOUBLE) / 1e6, 6) AS diff_time FROM ({DET})""")
def win_lag_timediff(spark, d):
    det = T.detections(spark, d).select("tag", "ts", "tie")
    return rounded(M.lag_timediff(det), ["diff_time"])


@query("win_lead_timediff", f"""
SELECT tag, ts, tie, round(CAST(epoch_us(LEAD(ts) {W_TAG}) - epoch_us(ts) AS DOUBLE) / 1e6, 6) AS time_next FROM ({DET})""")
def win_lead_timediff(spark, d):
    det = T.detections(spark, d).select("tag", "ts", "tie")
    return rounded(M.lead_timediff(det), ["time_next"])


@query("win_prev_next_value", f"""
SELECT tag, tie, site, rkm, LAG(rkm) {W_TAG} AS prev_rkm, LEAD(rkm) {W_TAG} AS next_rkm,
       LAG(site) {W_TAG} AS prev_site FROM ({DETR})""")
def win_prev_next_value(spark, d):
    x = W.sequence_shift(_det_rkm(spark, d), ["tag"], "ts", "tie",
                         lags={"prev_rkm": "rkm", "prev_site": "site"}, leads={"next_rkm": "rkm"})
    return x.select("tag", "tie", "site", "rkm", "prev_rkm", "next_rkm", "prev_site")


@query("win_transition_flag", f"""
SELECT tag, tie, site, CASE WHEN LAG(site) {W_TAG} IS NULL THEN NULL
                            WHEN site = LAG(site) {W_TAG} THEN false ELSE true END AS transition FROM ({DET})""")
def win_transition_flag(spark, d):
    t = M.transitions(T.detections(spark, d).select("tag", "site", "ts", "tie"))
    return t.select("tag", "tie", "site", "transition")


@query("win_distance", f"SELECT tag, tie, round(LAG(rkm) {W_TAG} - rkm, 6) AS dist_traveled FROM ({DETR})")
def win_distance(spark, d):
    x = W.sequence_shift(_det_rkm(spark, d), ["tag"], "ts", "tie", lags={"prev_rkm": "rkm"})
    return rounded(x.select("tag", "tie", (F.col("prev_rkm") - F.col("rkm")).alias("dist_traveled")),
                   ["dist_traveled"])


@query("win_row_number_first", f"""
SELECT tag, site, ts, tie FROM (SELECT *, row_number() OVER (PARTITION BY tag, site ORDER BY ts, tie) AS rn FROM ({DET})) WHERE rn = 1""")
def win_row_number_first(spark, d):
    det = T.detections(spark, d).select("tag", "site", "ts", "tie")
    return W.first_per_group(det, ["tag", "site"], "ts", "tie")


@query("win_row_number_nth", f"""
SELECT tag, site, ts, tie FROM (SELECT *, row_number() OVER (PARTITION BY tag, site ORDER BY ts, tie) AS rn FROM ({DET})) WHERE rn = 2""")
def win_row_number_nth(spark, d):
    det = T.detections(spark, d).select("tag", "site", "ts", "tie")
    return W.nth_per_group(det, ["tag", "site"], "ts", "tie", 2)


_RECOMP_COLS = ["time_prev", "prev_rkm", "next_rkm", "time_next", "dist_traveled",
                "speed_bodyL_secs", "time_diff_days", "speed_km_day"]


@query("win_recompute_after_filter", f"""
WITH a AS (SELECT *, LAG(rkm) {W_TAG} AS prev_rkm, LAG(site) {W_TAG} AS prev_site FROM ({DETR})),
k AS (SELECT tag, site, ts, tie, rkm FROM a WHERE (rkm < prev_rkm AND site <> prev_site) OR site = 'signup'),
b AS (SELECT *, CAST(epoch_us(ts) - epoch_us(LAG(ts) {W_TAG}) AS DOUBLE) / 1e6 AS tp,
             LAG(site) {W_TAG} AS ps, LAG(rkm) {W_TAG} AS prev_rkm, LEAD(rkm) {W_TAG} AS next_rkm,
             CAST(epoch_us(LEAD(ts) {W_TAG}) - epoch_us(ts) AS DOUBLE) / 1e6 AS tn FROM k)
SELECT tag, site, ts, tie, rkm, round(tp, 6) AS time_prev,
       CASE WHEN ps IS NULL THEN NULL WHEN site = ps THEN false ELSE true END AS transition,
       round(prev_rkm, 6) AS prev_rkm, round(next_rkm, 6) AS next_rkm, round(tn, 6) AS time_next,
       round(prev_rkm - rkm, 6) AS dist_traveled,
       round(CASE WHEN tp = 0 THEN NULL ELSE ((prev_rkm - rkm) / 0.0012) / tp END, 6) AS speed_bodyL_secs,
       round(tp / 86400.0, 6) AS time_diff_days,
       round(CASE WHEN tp / 86400.0 = 0 THEN NULL ELSE (prev_rkm - rkm) / (tp / 86400.0) END, 6) AS speed_km_day
FROM b""")
def win_recompute_after_filter(spark, d):
    x = _det_rkm(spark, d)
    a = W.sequence_shift(x, ["tag"], "ts", "tie", lags={"prev_rkm": "rkm", "prev_site": "site"})
    a = a.withColumn("transition", N.if_else(F.col("site") == F.col("prev_site"), False, True))
    # keep downstream moves, plus the release rows, then recompute
    kept = a.filter(((F.col("rkm") < F.col("prev_rkm")) & F.col("transition"))
                    | (F.col("site") == T.RELEASE_SITE)).select("tag", "site", "ts", "tie", "rkm")
    return rounded(M.movement_metrics(kept), _RECOMP_COLS)


@query("win_direction", f"""
WITH a AS (SELECT tag, ts, tie, site, LAG(site) {W_TAG} AS last_loc FROM ({DET}))
SELECT tag, ts, tie, site, last_loc,
       CASE WHEN site IN ('signup') AND coalesce(last_loc IN ('view'), false) THEN 'UP' ELSE 'DOWN' END AS move_dir FROM a""")
def win_direction(spark, d):
    det = T.detections(spark, d).select("tag", "ts", "tie", "site")
    return M.direction(det, T.UPSTREAM_SITES, T.DOWNSTREAM_SITES)
