"""Named end-to-end pipelines (survey 2.13) on the driver bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from smolt.operators import movement as M
from smolt.operators import reshape as R
from smolt.operators import windows as W
from smolt.plans.common import STATS, rounded, stats_sql
from smolt.plans.registry import query
from smolt.plans.sqlparts import DET
from smolt.sources import tables as T

UP = T.UPSTREAM_SITES[0]


@query("segment_durations", f"""
WITH det AS ({DET}),
g1 AS (SELECT *, CAST(epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY tag ORDER BY ts, tie)) AS DOUBLE) / 1e6 AS d FROM det),
g2 AS (SELECT tag, site, ts, tie FROM g1 WHERE d >= 45),
t AS (SELECT *, LAG(site) OVER (PARTITION BY tag ORDER BY ts, tie) AS prev_site FROM g2),
s AS (SELECT * FROM t WHERE prev_site IS NOT NULL AND site <> prev_site),
s2 AS (SELECT site AS location_site, LAG(site) OVER w AS prev_location,
              CAST(epoch_us(ts) - epoch_us(LAG(ts) OVER w) AS DOUBLE) / 86400e6 AS time_to
       FROM s WINDOW w AS (PARTITION BY tag ORDER BY ts, tie))
SELECT location_site, prev_location, {stats_sql('time_to')},
       prev_location || ' to ' || location_site AS prev_current
FROM s2 GROUP BY location_site, prev_location
HAVING location_site <> '{UP}' AND prev_location IS NOT NULL AND prev_location <> '{UP}'
""")
def segment_durations(spark, d):
    det = T.detections(spark, d).select("tag", "site", "ts", "tie")
    kept = M.gap_filter(det, 45.0)
    out = M.segment_durations(kept, T.UPSTREAM_SITES)
    return rounded(out, STATS)


# ------------------------------------------------------------------ pipelines

from smolt.functions.nullsafe import isin_safe  # noqa: E402
from smolt.operators import aggregates as A  # noqa: E402
from smolt.operators import joins as J  # noqa: E402
from smolt.plans import pipelines as P  # noqa: E402
from smolt.plans.q_joins import BEST_SQL, repeated_ids  # noqa: E402
from smolt.plans.sqlparts import REL, SITES, TAGS  # noqa: E402

W_TAG = "OVER (PARTITION BY tag ORDER BY ts, tie)"
CONTROL, EXCLUDED = "1-URGENT", "5-LOW"
INJURIES = ["inj_returned", "inj_open", "inj_discount", "inj_tax"]


def _recaptures(spark, d):
    li = T.table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("tag"), "l_linenumber",
                     F.col("l_shipdate").alias("sample_ts"),
                     (F.col("l_returnflag") == "R").cast("int").alias("inj_returned"),
                     (F.col("l_linestatus") == "O").cast("int").alias("inj_open"),
                     (F.col("l_discount") >= 0.05).cast("int").alias("inj_discount"),
                     (F.col("l_tax") >= 0.04).cast("int").alias("inj_tax"))


def _pit_releases(spark, d):
    o = T.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("tag"), F.col("o_orderdate").alias("release_ts"),
                    F.col("o_orderpriority").alias("treatment"))


def _recap_final(spark, d):
    return P.pit_recapture(_pit_releases(spark, d), _recaptures(spark, d), "tag", "release_ts",
                           "sample_ts", "treatment", 60.0, "days", exclude=[EXCLUDED],
                           control=[CONTROL])


RECAP_SQL = f"""
SELECT l.l_orderkey AS tag, l.l_linenumber, o.o_orderpriority AS treatment,
       CAST(epoch_us(l.l_shipdate) - epoch_us(o.o_orderdate) AS DOUBLE) / 86400e6 AS time_diff,
       CASE WHEN o.o_orderpriority IN ('{CONTROL}') THEN 'control' ELSE 'archimedes' END AS release_group,
       CAST(l.l_returnflag = 'R' AS INTEGER) AS inj_returned, CAST(l.l_linestatus = 'O' AS INTEGER) AS inj_open,
       CAST(l.l_discount >= 0.05 AS INTEGER) AS inj_discount, CAST(l.l_tax >= 0.04 AS INTEGER) AS inj_tax
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE CAST(epoch_us(l.l_shipdate) - epoch_us(o.o_orderdate) AS DOUBLE) / 86400e6 < 60
  AND (o.o_orderpriority IS NULL OR o.o_orderpriority NOT IN ('{EXCLUDED}'))"""


@query("pit_recapture", f"""
SELECT tag, l_linenumber, round(time_diff, 6) AS time_diff, treatment, release_group FROM ({RECAP_SQL})""")
def pit_recapture(spark, d):
    r = _recap_final(spark, d)
    return rounded(r.select("tag", "l_linenumber", "time_diff", "treatment", "release_group"),
                   ["time_diff"])


@query("pit_best_match", f"""
SELECT tag, l_orderkey, l_linenumber, release_id, treatment, round(CAST(epoch_us(sample_ts) - epoch_us(release_ts) AS DOUBLE) / 86400e6, 6) AS time_diff,
       CASE WHEN treatment IN ('{CONTROL}') THEN 'control' ELSE 'archimedes' END AS release_group
FROM ({BEST_SQL}) WHERE release_ts IS NOT NULL AND CAST(epoch_us(sample_ts) - epoch_us(release_ts) AS DOUBLE) / 86400e6 < 60
  AND (treatment IS NULL OR treatment NOT IN ('{EXCLUDED}'))""")
def pit_best_match(spark, d):
    """PIT recaptures where ids repeat: each sample counts for one release."""
    samples, releases = repeated_ids(spark, d)
    out = P.pit_best_match(releases, samples, "tag", "release_ts", "sample_ts", "treatment", 60.0, "days", exclude=[EXCLUDED], control=[CONTROL])
    return rounded(out.select("tag", "l_orderkey", "l_linenumber", "release_id", "treatment", "time_diff", "release_group"), ["time_diff"])


@query("injury_summary", f"""
WITH r AS ({RECAP_SQL}),
l AS (SELECT CASE WHEN treatment IN ('{CONTROL}') THEN 'control' ELSE 'pump' END AS pump, injury, value
      FROM r UNPIVOT (value FOR injury IN ({', '.join(INJURIES)})))
SELECT injury, CAST(sum(CASE WHEN pump = 'control' THEN value END) AS BIGINT) AS control,
       CAST(sum(CASE WHEN pump = 'pump' THEN value END) AS BIGINT) AS pump FROM l GROUP BY injury""")
def injury_summary(spark, d):
    out = P.injury_summary(_recap_final(spark, d), "treatment", INJURIES, control=[CONTROL])
    return out.select("injury", F.col("control").cast("long"), F.col("pump").cast("long"))


@query("tag_release_meta", """
WITH t AS (SELECT c_custkey AS tag, c_nationkey, c_acctbal FROM customer),
e AS (SELECT n.n_nationkey AS c_nationkey, r.r_name AS release_location FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
j AS (SELECT t.tag, t.c_acctbal, e.release_location FROM t FULL OUTER JOIN e ON t.c_nationkey = e.c_nationkey)
SELECT release_location, CAST(count(DISTINCT tag) + max(CASE WHEN tag IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_tags,
       round(avg(c_acctbal), 6) AS mean_size FROM j GROUP BY release_location""")
def tag_release_meta(spark, d):
    tags = T.table(spark, d, "customer").select(F.col("c_custkey").alias("tag"), "c_nationkey", "c_acctbal")
    n = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    r = T.table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"),
                                           F.col("r_name").alias("release_location"))
    events = n.join(r, "n_regionkey").drop("n_regionkey")
    out = P.tag_release_meta(tags, events, ["c_nationkey"], "release_location", "c_acctbal")
    return rounded(out, ["mean_size"])


BENCH, FLOODGATE = ["view"], ["purchase"]


def _study(spark, d):
    return T.tags(spark, d).filter(F.col("release_group") != "HOUSEHOLD").select("tag")


def _clean(spark, d):
    det = T.detections(spark, d).select("tag", "site", "ts", "tie", "value")
    return P.detection_clean(det, _study(spark, d), T.releases(spark, d), T.sites(spark),
                             T.tags(spark, d), bench_sites=BENCH, floodgate_sites=FLOODGATE)


CLEAN_SQL = f"""
WITH d AS ({DET}),
s AS (SELECT * FROM d WHERE tag IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'HOUSEHOLD') AND site NOT IN ('view')),
a AS (SELECT s.* FROM s JOIN ({REL}) r ON s.tag = r.tag WHERE s.ts > r.release_ts),
g1 AS (SELECT *, CAST(epoch_us(ts) - epoch_us(LAG(ts) {W_TAG}) AS DOUBLE) / 1e6 AS gap FROM a),
g2 AS (SELECT tag, site, ts, tie, value FROM g1 WHERE gap >= 45),
g3 AS (SELECT *, CAST(epoch_us(ts) - epoch_us(LAG(ts) {W_TAG}) AS DOUBLE) / 1e6 AS diff_time FROM g2)
SELECT g3.tag, g3.site, g3.ts, g3.tie, g3.value, g3.diff_time, st.rkm, t.release_group
FROM g3 JOIN ({SITES}) st ON g3.site = st.site JOIN ({TAGS}) t ON g3.tag = t.tag WHERE g3.site NOT IN ('purchase')"""


@query("detection_clean", f"""
SELECT tag, site, ts, tie, round(diff_time, 6) AS diff_time, rkm, release_group FROM ({CLEAN_SQL})""")
def detection_clean(spark, d):
    c = _clean(spark, d)
    return rounded(c.select("tag", "site", "ts", "tie", "diff_time", "rkm", "release_group"),
                   ["diff_time"])


@query("receiver_overlap", f"""
WITH d AS ({DET}), a AS (SELECT DISTINCT tag FROM d WHERE site = 'click'),
b AS (SELECT tag FROM d WHERE value > 90 AND site IN ('view', 'signup'))
SELECT t.release_group, CAST(count(DISTINCT a.tag) AS BIGINT) AS n_tags
FROM a JOIN ({TAGS}) t ON a.tag = t.tag WHERE a.tag NOT IN (SELECT tag FROM b) GROUP BY t.release_group""")
def receiver_overlap(spark, d):
    det = T.detections(spark, d)
    other = det.filter((F.col("value") > 90) & isin_safe("site", ["view", "signup"]))
    return P.receiver_overlap(det, T.tags(spark, d), "click", other)


@query("upstream_artifact_filter", f"""
WITH a AS (SELECT tag, ts, tie, site, LAG(site) {W_TAG} AS last_loc FROM ({DET})),
b AS (SELECT *, CASE WHEN site IN ('signup') AND coalesce(last_loc IN ('view'), false) THEN 'UP' ELSE 'DOWN' END AS move_dir FROM a)
SELECT * FROM b WHERE NOT (site IN ('signup') AND move_dir = 'UP')""")
def upstream_artifact_filter(spark, d):
    det = T.detections(spark, d).select("tag", "ts", "tie", "site")
    return P.upstream_artifact_filter(det, T.UPSTREAM_SITES, T.DOWNSTREAM_SITES, T.UPSTREAM_SITES)


LOCAL, RIVER = ["signup", "view", "click"], ["purchase", "error"]
MERGED_SQL = f"""
SELECT tag, ts, site AS receiver, site AS location_site, 'local' AS site_label, 'detection' AS type FROM ({DET}) WHERE site IN ('signup', 'view', 'click')
UNION ALL SELECT tag, ts, site, upper(site), 'fraser', 'detection' FROM ({DET}) WHERE site IN ('purchase', 'error')
UNION ALL SELECT tag, release_ts, 'release', 'release', 'release', 'release' FROM ({REL})"""


def _merged(spark, d):
    det = T.detections(spark, d)
    return P.merge_arrays(det.filter(isin_safe("site", LOCAL)), det.filter(isin_safe("site", RIVER)),
                          T.releases(spark, d), "fraser", "release")


@query("merge_arrays", MERGED_SQL)
def merge_arrays(spark, d):
    return _merged(spark, d)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("detection_summary", f"""
SELECT m.location_site, {', '.join(f"CAST(NULLIF(count(DISTINCT CASE WHEN t.release_group = '{s}' THEN m.tag END), 0) AS BIGINT) AS {s}" for s in SEGMENTS)}
FROM ({MERGED_SQL}) m JOIN ({TAGS}) t ON m.tag = t.tag GROUP BY m.location_site""")
def detection_summary(spark, d):
    return P.detection_summary(_merged(spark, d), T.tags(spark, d), SEGMENTS)


@query("non_study_tags", f"""
WITH f AS (SELECT * FROM ({DET}) WHERE site NOT IN ('view')
           AND tag NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')),
c AS (SELECT tag, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY tag HAVING count(*) > 1)
SELECT tag, n, CASE WHEN tag IN (SELECT tag FROM f WHERE value > 95) THEN 'Yes' ELSE 'No' END AS sensor FROM c""")
def non_study_tags(spark, d):
    det = T.detections(spark, d)
    return P.non_study_tags(det, _study(spark, d), F.col("value") > 95, drop_sites=BENCH)


MOVE_COLS = ["time_prev", "prev_rkm", "next_rkm", "time_next", "dist_traveled",
             "speed_bodyL_secs", "time_diff_days", "speed_km_day"]


RELEASE_RKM = 120.5  # fixed value: river km given to the release rows


@query("movement_metrics", f"""
WITH a AS (SELECT tag, site, ts, tie, rkm, LAG(site) {W_TAG} AS ps, LAG(rkm) {W_TAG} AS pr FROM ({CLEAN_SQL})),
k AS (SELECT tag, site, ts, tie, rkm FROM a WHERE rkm < pr AND site <> ps
      UNION ALL SELECT tag, 'release', release_ts, -1, {RELEASE_RKM} FROM ({REL})
      WHERE tag IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')),
b AS (SELECT tag, site, ts, tie, rkm, CAST(epoch_us(ts) - epoch_us(LAG(ts) {W_TAG}) AS DOUBLE) / 1e6 AS tp,
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
def movement_metrics(spark, d):
    """Both passes: metrics of the cleaned detections, then again over the
    downstream transitions with the release rows put back."""
    c = _clean(spark, d).select("tag", "site", "ts", "tie", "rkm")
    first = M.movement_metrics(c)
    down = first.filter((F.col("rkm") < F.col("prev_rkm")) & F.col("transition")).select("tag", "site", "ts", "tie", "rkm")
    released = T.releases(spark, d).join(_study(spark, d), "tag", "left_semi")
    c = R.add_event_rows(down, released, "tag", "ts", "release_ts",
                         {"site": "release", "tie": F.lit(-1).cast("long"), "rkm": F.lit(RELEASE_RKM)})
    return rounded(M.movement_metrics(c), MOVE_COLS)


DETR = f"SELECT d.tag, d.site, d.ts, d.tie, s.rkm FROM ({DET}) d JOIN ({SITES}) s ON d.site = s.site"


def _det_rkm(spark, d):
    return J.join_dim(T.detections(spark, d).select("tag", "site", "ts", "tie"), T.sites(spark), "site")


@query("residence_time", f"""
WITH fl AS (SELECT tag, site, rkm, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 3600e6 AS duration
            FROM ({DETR}) GROUP BY tag, site, rkm)
SELECT site, rkm, round(quantile_cont(duration, 0.5), 6) AS median, round(min(duration), 6) AS min,
       round(max(duration), 6) AS max FROM fl GROUP BY site, rkm""")
def residence_time(spark, d):
    return rounded(P.residence_summary(_det_rkm(spark, d)), ["median", "min", "max"])


LATER = ["click", "purchase", "error"]


@query("long_residence_followup", f"""
WITH fl AS (SELECT tag, site, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 3600e6 AS duration FROM ({DET}) GROUP BY tag, site),
stay AS (SELECT tag FROM fl WHERE site = 'view' AND duration > 72)
SELECT tag, site, CAST(count(*) AS BIGINT) AS n FROM ({DET})
WHERE site IN ('click', 'purchase', 'error') AND tag IN (SELECT tag FROM stay) GROUP BY tag, site""")
def long_residence_followup(spark, d):
    det = T.detections(spark, d).select("tag", "site", "ts", "tie")
    return P.long_residence_followup(det, "view", 72.0, LATER)


def _first_sql(site: str, div: str) -> str:
    return f"""
WITH p AS (SELECT tag, ts AS first_ts, row_number() OVER (PARTITION BY tag ORDER BY ts, tie) AS rn FROM ({DET}) WHERE site = '{site}'),
e AS (SELECT p.tag, CAST(epoch_us(p.first_ts) - epoch_us(r.release_ts) AS DOUBLE) / {div} AS elapsed
      FROM p JOIN ({REL}) r ON p.tag = r.tag WHERE p.rn = 1)
SELECT t.release_group, {stats_sql('elapsed')} FROM e JOIN ({TAGS}) t ON e.tag = t.tag GROUP BY t.release_group"""


@query("passage_time", _first_sql("view", "3600e6"))
def passage_time(spark, d):
    det = T.detections(spark, d).select("tag", "site", "ts", "tie")
    t = P.time_to_first(det, T.releases(spark, d), T.tags(spark, d), "view", "hours")
    return rounded(A.summarise_stats(t, ["release_group"], "elapsed"), STATS)


@query("arrival_time", _first_sql("error", "86400e6"))
def arrival_time(spark, d):
    det = T.detections(spark, d).select("tag", "site", "ts", "tie")
    t = P.time_to_first(det, T.releases(spark, d), T.tags(spark, d), "error", "days")
    return rounded(A.summarise_stats(t, ["release_group"], "elapsed"), STATS)


@query("history_tables", None)
def history_tables(spark, d):
    from smolt.plans.q_survival import histories
    a = histories(spark, d).withColumn("table", F.lit("all_dets"))
    b = histories(spark, d, min_count=2).withColumn("table", F.lit("no_single_dets"))
    return a.unionByName(b)


@query("survival_comparison")
def survival_comparison(spark, d):
    """Two history tables x two models; betas and real-scale estimates
    with 95% intervals (rows-only check)."""
    from smolt.operators import histories as H
    from smolt.operators import survival as S
    from smolt.plans.q_survival import K, histories
    from smolt.session import reuse_small
    # sightings per tag x occasion, computed once for both tables
    seen = reuse_small(T.occasions_table(spark, d).groupBy("tag", "grp", "occ")
                       .agg(F.count(F.lit(1)).alias("n_seen")))
    a = H.history_frequency(H.encounter_history(seen, "tag", "grp", "occ", K), "grp") \
        .withColumn("dataset", F.lit("all_dets"))
    b = H.history_frequency(H.encounter_history(seen.filter(F.col("n_seen") >= 2), "tag", "grp",
                                                "occ", K), "grp") \
        .withColumn("dataset", F.lit("no_single_dets"))
    fits = S.fit_models(a.unionByName(b), "grp", SEGMENTS, K, [("dot", "dot"), ("group", "dot")])
    return S.real_estimates(fits)


MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
MONTH_CODES = {m: f"{i + 1:02d}" for i, m in enumerate(MONTHS)}
MIN_YEAR, THRESHOLD = 1998, 150000.0


@query("discharge_long", None)
def discharge_long(spark, d):
    from smolt.plans.q_reshape import monthly_wide
    out = P.discharge_long(monthly_wide(spark, d), ["YEAR", "DD"], MONTHS, MONTH_CODES,
                           MIN_YEAR, THRESHOLD)
    return out.withColumn("date2", F.col("date2").cast("timestamp_ntz"))


def _register_late_sql():
    from smolt.plans.q_reshape import WIDE_SQL
    from smolt.plans.q_survival import HIST2_SQL, HIST_SQL
    from smolt.plans.registry import ORACLE
    ORACLE["history_tables"] = " ".join(f"""
SELECT tag, grp, ch, 'all_dets' AS "table" FROM ({HIST_SQL})
UNION ALL SELECT tag, grp, ch, 'no_single_dets' AS "table" FROM ({HIST2_SQL})""".split())
    codes = " ".join(f"WHEN '{m}' THEN '{c}'" for m, c in MONTH_CODES.items())
    ORACLE["discharge_long"] = " ".join(f"""
WITH l AS (SELECT "YEAR", DD, month, discharge FROM ({WIDE_SQL}) UNPIVOT (discharge FOR month IN ({', '.join(MONTHS)}))),
m AS (SELECT *, CASE month {codes} ELSE month END AS month2 FROM l),
x AS (SELECT *, TRY_CAST(CAST("YEAR" AS VARCHAR) || '-' || month2 || '-' || lpad(CAST(DD AS VARCHAR), 2, '0') AS DATE) AS dd2 FROM m)
SELECT "YEAR", DD, month, discharge, month2, CAST(dd2 AS TIMESTAMP) AS date2, CAST(dayofyear(dd2) AS INTEGER) AS doy,
       ("YEAR" >= {MIN_YEAR} AND discharge > {THRESHOLD}) AS in_plot FROM x WHERE discharge IS NOT NULL""".split())


_register_late_sql()
