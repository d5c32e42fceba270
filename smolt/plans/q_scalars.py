"""Scalar functions (survey 2.9), all JVM-side built-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from smolt.functions import nullsafe as N
from smolt.functions import scalars as S
from smolt.operators import joins as J
from smolt.operators import windows as W
from smolt.plans.common import rounded
from smolt.plans.registry import query
from smolt.plans.sqlparts import DET, REL, SITES
from smolt.sources import tables as T

ZONE = "America/Vancouver"


@query("fn_concat_ws", f"""
SELECT tag, tie, CAST(tag AS VARCHAR) || '_' || coalesce(CASE WHEN value > 90 THEN NULL ELSE site END, 'NA') AS label FROM ({DET})""")
def fn_concat_ws(spark, d):
    det = T.detections(spark, d)
    site_n = F.when(F.col("value") > 90, F.lit(None)).otherwise(F.col("site"))
    return det.select("tag", "tie", S.paste("tag", site_n, sep="_").alias("label"))


@query("fn_regexp_strip_prefix", f"""
SELECT tag, 'A69-1604-' || CAST(tag AS VARCHAR) AS transmitter,
       regexp_replace('A69-1604-' || CAST(tag AS VARCHAR), '^.*-', '') AS serial FROM (SELECT DISTINCT tag FROM ({DET}))""")
def fn_regexp_strip_prefix(spark, d):
    t = T.detections(spark, d).select("tag").distinct()
    t = t.withColumn("transmitter", F.concat(F.lit("A69-1604-"), F.col("tag").cast("string")))
    return t.withColumn("serial", S.strip_prefix("transmitter"))


@query("fn_regexp_replace", f"""
WITH r AS (SELECT tie, CASE WHEN site IN ('click', 'view') THEN 'VR2W-' ELSE 'VR2Tx-' END || site AS receiver FROM ({DET}))
SELECT tie, receiver, regexp_replace(regexp_replace(receiver, 'VR2W-', '', 'g'), 'VR2Tx-', '', 'g') AS receiver_id FROM r""")
def fn_regexp_replace(spark, d):
    det = T.detections(spark, d)
    pre = F.when(N.isin_safe("site", ["click", "view"]), F.lit("VR2W-")).otherwise(F.lit("VR2Tx-"))
    r = det.select("tie", F.concat(pre, F.col("site")).alias("receiver"))
    rid = F.regexp_replace(F.regexp_replace("receiver", "VR2W-", ""), "VR2Tx-", "")
    return r.withColumn("receiver_id", rid)


_DTXT = "CAST(year(o_orderdate) AS VARCHAR) || '-02-' || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0')"


@query("fn_parse_date", f"""
SELECT o_orderkey, {_DTXT} AS txt, CAST(TRY_CAST({_DTXT} AS DATE) AS TIMESTAMP) AS date2 FROM orders""")
def fn_parse_date(spark, d):
    o = T.table(spark, d, "orders")
    txt = F.concat(F.year("o_orderdate").cast("string"), F.lit("-02-"),
                   F.lpad(F.dayofmonth("o_orderdate").cast("string"), 2, "0"))
    # the parsed DATE is returned as a midnight timestamp (same cell type in
    # every client library)
    return o.select("o_orderkey", txt.alias("txt")).withColumn(
        "date2", S.parse_date("txt").cast("timestamp_ntz"))


@query("fn_parse_ts", f"""
WITH x AS (SELECT tie, CASE WHEN tie % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                            ELSE strftime(ts, '%Y-%m-%d %-I:%M:%S %p') END AS txt FROM ({DET}))
SELECT tie, txt, coalesce(try_strptime(txt, '%Y-%m-%d %H:%M:%S'), try_strptime(txt, '%Y-%m-%d %I:%M:%S %p')) AS parsed FROM x""")
def fn_parse_ts(spark, d):
    det = T.detections(spark, d)
    txt = F.when(F.col("tie") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")) \
        .otherwise(F.date_format("ts", "yyyy-MM-dd h:mm:ss a"))
    x = det.select("tie", txt.alias("txt"))
    return x.withColumn("parsed", S.parse_ts("txt", ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd h:mm:ss a")))


@query("fn_tz_relabel", f"""
SELECT tag, release_ts, timezone('UTC', timezone('{ZONE}', release_ts)) AS release_utc FROM ({REL})""")
def fn_tz_relabel(spark, d):
    r = T.releases(spark, d)
    return r.withColumn("release_utc", S.tz_relabel(F.col("release_ts").cast("timestamp"), ZONE))


@query("fn_tz_convert", f"""
SELECT tie, ts, timezone('{ZONE}', timezone('UTC', ts)) AS ts_local FROM ({DET})""")
def fn_tz_convert(spark, d):
    det = T.detections(spark, d).select("tie", "ts")
    return det.withColumn("ts_local", S.tz_convert(F.col("ts").cast("timestamp"), ZONE))


@query("fn_timediff_unit", f"""
WITH j AS (SELECT d.tag, d.tie, CAST(epoch_us(d.ts) - epoch_us(r.release_ts) AS DOUBLE) AS us
           FROM ({DET}) d JOIN ({REL}) r ON d.tag = r.tag)
SELECT tag, tie, round(us / 1e6, 6) AS d_secs, round(us / 60e6, 6) AS d_mins,
       round(us / 3600e6, 6) AS d_hours, round(us / 86400e6, 6) AS d_days FROM j""")
def fn_timediff_unit(spark, d):
    j = T.detections(spark, d).select("tag", "tie", "ts").join(T.releases(spark, d), "tag")
    out = j.select("tag", "tie", *[S.timediff("ts", "release_ts", u).alias(f"d_{u}")
                                   for u in ("secs", "mins", "hours", "days")])
    return rounded(out, ["d_secs", "d_mins", "d_hours", "d_days"])


@query("fn_day_of_year", "SELECT o_orderkey, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy FROM orders")
def fn_day_of_year(spark, d):
    return T.table(spark, d, "orders").select("o_orderkey", S.day_of_year("o_orderdate").alias("doy"))


@query("fn_if_else", f"""
SELECT tie, CASE WHEN v IS NULL THEN NULL WHEN v > 50 THEN 'high' ELSE 'low' END AS level
FROM (SELECT tie, CASE WHEN site = 'error' THEN NULL ELSE value END AS v FROM ({DET}))""")
def fn_if_else(spark, d):
    det = T.detections(spark, d)
    v = F.when(F.col("site") == "error", F.lit(None)).otherwise(F.col("value"))
    return det.select("tie", N.if_else(v > 50, "high", "low").alias("level"))


RECODE = {"AUTOMOBILE": "auto", "BUILDING": "build"}


@query("fn_recode_map", """
SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'auto' WHEN 'BUILDING' THEN 'build' ELSE c_mktsegment END AS seg2 FROM customer""")
def fn_recode_map(spark, d):
    c = T.table(spark, d, "customer")
    return c.select("c_custkey", S.recode("c_mktsegment", RECODE).alias("seg2"))


@query("fn_ceiling", "SELECT l_orderkey, l_linenumber, CAST(ceil(l_quantity / 16) AS BIGINT) AS pages FROM lineitem")
def fn_ceiling(spark, d):
    li = T.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", S.ceil_int(F.col("l_quantity") / 16).alias("pages"))


@query("fn_inverse_logit", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_discount * 10 - 0.5))), 6) AS p FROM lineitem")
def fn_inverse_logit(spark, d):
    li = T.table(spark, d, "lineitem")
    out = li.select("l_orderkey", "l_linenumber",
                    S.inverse_logit(F.col("l_discount") * 10 - 0.5).alias("p"))
    return rounded(out, ["p"])


@query("fn_unit_speed", f"""
WITH a AS (SELECT d.tag, d.tie, s.rkm, LAG(s.rkm) OVER w - s.rkm AS dist,
                  CAST(epoch_us(d.ts) - epoch_us(LAG(d.ts) OVER w) AS DOUBLE) / 1e6 AS secs
           FROM ({DET}) d JOIN ({SITES}) s ON d.site = s.site WINDOW w AS (PARTITION BY d.tag ORDER BY d.ts, d.tie))
SELECT tag, tie, round(CASE WHEN secs / 86400.0 = 0 THEN NULL ELSE dist / (secs / 86400.0) END, 6) AS speed_km_day,
       round(CASE WHEN secs = 0 THEN NULL ELSE (dist / 0.0012) / secs END, 6) AS speed_bodyL_secs FROM a""")
def fn_unit_speed(spark, d):
    x = J.join_dim(T.detections(spark, d).select("tag", "site", "ts", "tie"), T.sites(spark), "site")
    x = W.sequence_shift(x, ["tag"], "ts", "tie", lags={"__prkm": "rkm", "__pts": "ts"})
    dist = F.col("__prkm") - F.col("rkm")
    secs = S.timediff("ts", "__pts")
    out = x.select("tag", "tie", S.unit_speed(dist, secs, per="days").alias("speed_km_day"),
                   S.unit_speed(dist, secs, body_length=0.0012).alias("speed_bodyL_secs"))
    return rounded(out, ["speed_km_day", "speed_bodyL_secs"])
