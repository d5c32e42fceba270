"""Group statistics (survey 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from smolt.functions import distributions as Dist
from smolt.operators import aggregates as A
from smolt.operators import joins as J
from smolt.operators import stats as St
from smolt.operators import windows as W
from smolt.functions.scalars import timediff, unit_speed
from smolt.plans.common import rounded
from smolt.plans.registry import query
from smolt.plans.sqlparts import DET, SITES
from smolt.sources import tables as T

WELCH_COLS = ["mean_a", "mean_b", "estimate", "t", "df"]


@query("welch_t_test", """
WITH s AS (SELECT count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_a, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS mean_a,
                  var_samp(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS var_a,
                  count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS n_b, avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS mean_b,
                  var_samp(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS var_b
           FROM orders WHERE o_totalprice IS NOT NULL AND o_orderstatus IN ('F', 'O'))
SELECT 'F' AS group_a, 'O' AS group_b, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b,
       round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_a - mean_b, 6) AS estimate,
       round((mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b), 6) AS t,
       round(pow(var_a / n_a + var_b / n_b, 2) / (pow(var_a / n_a, 2) / (n_a - 1) + pow(var_b / n_b, 2) / (n_b - 1)), 6) AS df
FROM s""")
def welch_t_test(spark, d):
    o = T.table(spark, d, "orders")
    return rounded(St.welch_t_test(o, "o_totalprice", "o_orderstatus", "F", "O"), WELCH_COLS)


_STEPS = 40_000  # of Simpson's rule
_BETA = "exp(lgamma((df + 1) / 2) - lgamma(df / 2))"


def _t_tail(t: str) -> str:
    """P(|T| > t) as an aggregate over range(0, _STEPS + 1) r(i): Simpson's
    rule over atan(t / sqrt(df)), no continued fraction."""
    a = f"atan({t} / sqrt(df))"
    width = f"least(pi() / 2 - {a}, 14 / sqrt(df))"  # beyond it the density is below rounding
    y = f"pow(cos({a} + {width} * i / {_STEPS}.0), df - 1) * CASE WHEN i = 0 OR i = {_STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"2 * sum({y} * {width}) / {3 * _STEPS}.0 * any_value({_BETA}) / sqrt(pi())"


def _welch_p_sql() -> str:
    keep, over = "n_a, mean_a, n_b, mean_b, se, t, df", f"range(0, {_STEPS + 1}) r(i)"
    newton = "q0 AS (SELECT *, 1.959963984540054 AS q FROM w)"
    for k in range(1, 6):
        newton += (f", q{k} AS (SELECT {keep}, p, q + ({_t_tail('q')} - 0.05) / any_value(2 * {_BETA} / sqrt(df * pi()) * pow(1 + q * q / df, -(df + 1) / 2)) AS q "
                   f"FROM q{k - 1}, {over} GROUP BY {keep}, p, q{k - 1}.q)")
    return f"""
WITH s AS (SELECT count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_a, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS mean_a,
                  var_samp(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS var_a,
                  count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS n_b, avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS mean_b,
                  var_samp(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS var_b FROM orders),
v AS (SELECT *, sqrt(var_a / n_a + var_b / n_b) AS se, (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS t,
             pow(var_a / n_a + var_b / n_b, 2) / (pow(var_a / n_a, 2) / (n_a - 1) + pow(var_b / n_b, 2) / (n_b - 1)) AS df FROM s),
w AS (SELECT {keep}, {_t_tail('abs(t)')} AS p FROM v, {over} GROUP BY {keep}), {newton}
SELECT 'F' AS group_a, 'O' AS group_b, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
       round(mean_a - mean_b, 6) AS estimate, round(t, 6) AS t, round(df, 6) AS df, round(p, 6) AS p_value,
       round(mean_a - mean_b - q * se, 3) AS conf_low, round(mean_a - mean_b + q * se, 3) AS conf_high FROM q5"""


@query("welch_t_test_p", _welch_p_sql())
def welch_t_test_p(spark, d):
    """Same test with the two-sided p-value and the interval of the difference."""
    o = T.table(spark, d, "orders")
    t = St.welch_t_test(o, "o_totalprice", "o_orderstatus", "F", "O", with_p=True)
    return rounded(rounded(t, [*WELCH_COLS, "p_value"]), ["conf_low", "conf_high"], 3)


def _poly_sql(coefs, x: str) -> str:
    return " + ".join(f"{c!r} * pow({x}, {i})" for i, c in enumerate(coefs))


def _horner_sql(coefs, x: str) -> str:
    out = repr(coefs[0])
    for c in coefs[1:]:
        out = f"({out}) * {x} + {c!r}"
    return f"({out})"


def _normal_sql(p: str) -> str:
    r, s, u = f"(({p} - 0.5) * ({p} - 0.5))", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    tail = lambda v: f"{_horner_sql(Dist.QUANTILE_C, v)} / {_horner_sql(Dist.QUANTILE_D, v)}"
    return (f"CASE WHEN {p} < {Dist.QUANTILE_CUT} THEN {tail(s)} WHEN {p} > 1 - {Dist.QUANTILE_CUT} THEN -{tail(u)} "
            f"ELSE {_horner_sql(Dist.QUANTILE_A, r)} * ({p} - 0.5) / {_horner_sql(Dist.QUANTILE_B, r)} END")


# groups of more than 11 values, by the definition: all coefficients of a group, W from them; the tail by Simpson's rule
SHAPIRO_SQL = f"""
WITH x AS (SELECT o_orderstatus AS g, o_totalprice::DOUBLE AS x, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS i,
                  count(*) OVER (PARTITION BY o_orderstatus)::DOUBLE AS n FROM orders WHERE o_totalprice IS NOT NULL),
m AS (SELECT *, (i - 0.375) / (n + 0.25) AS b FROM x), s AS (SELECT *, {_normal_sql('b')} AS m FROM m),
c AS (SELECT *, sum(m * m) OVER (PARTITION BY g) AS mm, max(m) OVER (PARTITION BY g) AS mn,
             max(CASE WHEN i = n - 1 THEN m END) OVER (PARTITION BY g) AS mn1, 1 / sqrt(n) AS u FROM s),
e AS (SELECT *, mn / sqrt(mm) + {_poly_sql((0.0, *St.SW_AN), 'u')} AS an, mn1 / sqrt(mm) + {_poly_sql((0.0, *St.SW_AN1), 'u')} AS an1 FROM c),
a AS (SELECT *, CASE WHEN i = n THEN an WHEN i = 1 THEN -an WHEN i = n - 1 THEN an1 WHEN i = 2 THEN -an1
             ELSE m / sqrt((mm - 2 * mn * mn - 2 * mn1 * mn1) / (1 - 2 * an * an - 2 * an1 * an1)) END AS a FROM e),
w AS (SELECT g, n, pow(sum(a * x), 2) / (var_samp(x) * (n - 1)) AS w FROM a GROUP BY g, n),
z AS (SELECT g, n, w, (ln(1 - w) - ({_poly_sql(St.SW_LARGE_MEAN, 'ln(n)')})) / exp({_poly_sql(St.SW_LARGE_SD, 'ln(n)')}) AS z FROM w)
SELECT g AS o_orderstatus, CAST(n AS BIGINT) AS n, round(w, 6) AS W,
       round((SELECT sum(exp(-pow(z.z + 12.0 * i / 4000, 2) / 2) * CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) / 1000 / sqrt(2 * pi())
              FROM range(0, 4001) r(i)), 6) AS p_value FROM z"""


@query("shapiro_wilk", SHAPIRO_SQL)
def shapiro_wilk(spark, d):
    """W and p of order values per order status."""
    return rounded(St.shapiro_wilk(T.table(spark, d, "orders"), "o_totalprice", ["o_orderstatus"]), ["W", "p_value"])


def _box_sql(src: str, v: str, by: str) -> str:
    return f"""
WITH s AS ({src}), q AS (SELECT {by}, CAST(count(*) AS BIGINT) AS n, quantile_cont({v}, 0.25) AS lower,
                               quantile_cont({v}, 0.5) AS middle, quantile_cont({v}, 0.75) AS upper
                        FROM s WHERE {v} IS NOT NULL GROUP BY {by}),
w AS (SELECT s.{by}, min(CASE WHEN {v} >= lower - 1.5 * (upper - lower) AND {v} <= upper + 1.5 * (upper - lower) THEN {v} END) AS ymin,
             max(CASE WHEN {v} >= lower - 1.5 * (upper - lower) AND {v} <= upper + 1.5 * (upper - lower) THEN {v} END) AS ymax,
             CAST(count(CASE WHEN NOT ({v} >= lower - 1.5 * (upper - lower) AND {v} <= upper + 1.5 * (upper - lower)) THEN 1 END) AS BIGINT) AS n_outliers
      FROM s JOIN q ON s.{by} = q.{by} WHERE {v} IS NOT NULL GROUP BY s.{by})
SELECT q.{by}, n, round(ymin, 6) AS ymin, round(lower, 6) AS lower, round(middle, 6) AS middle,
       round(upper, 6) AS upper, round(ymax, 6) AS ymax, n_outliers FROM q JOIN w ON q.{by} = w.{by}"""


BOX = ["ymin", "lower", "middle", "upper", "ymax"]


@query("boxplot_stats", _box_sql("SELECT l_returnflag, l_extendedprice FROM lineitem", "l_extendedprice", "l_returnflag"))
def boxplot_stats(spark, d):
    li = T.table(spark, d, "lineitem")
    return rounded(St.boxplot_stats(li, "l_extendedprice", ["l_returnflag"]), BOX)


DUR_SQL = (f"SELECT site, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 3600e6 AS duration "
           f"FROM ({DET}) GROUP BY tag, site")


@query("boxplot_duration", _box_sql(DUR_SQL, "duration", "site"))
def boxplot_duration(spark, d):
    fl = A.first_last(T.detections(spark, d), ["tag", "site"], "ts", "hours")
    return rounded(St.boxplot_stats(fl, "duration", ["site"]), BOX)


def _speeds(spark, d):
    x = J.join_dim(T.detections(spark, d).select("tag", "site", "ts", "tie"), T.sites(spark), "site")
    x = W.sequence_shift(x, ["tag"], "ts", "tie", lags={"__prkm": "rkm", "__pts": "ts"})
    dist = F.col("__prkm") - F.col("rkm")
    secs = timediff("ts", "__pts")
    return x.select(unit_speed(dist, secs, per="days").alias("speed_km_day"),
                    unit_speed(dist, secs, body_length=0.0012).alias("speed_bodyL_secs"))


SPEED_SQL = f"""
SELECT CASE WHEN secs / 86400.0 = 0 THEN NULL ELSE dist / (secs / 86400.0) END AS speed_km_day,
       CASE WHEN secs = 0 THEN NULL ELSE (dist / 0.0012) / secs END AS speed_bodyL_secs
FROM (SELECT LAG(s.rkm) OVER w - s.rkm AS dist, CAST(epoch_us(d.ts) - epoch_us(LAG(d.ts) OVER w) AS DOUBLE) / 1e6 AS secs
      FROM ({DET}) d JOIN ({SITES}) s ON d.site = s.site WINDOW w AS (PARTITION BY d.tag ORDER BY d.ts, d.tie))"""


@query("histogram_fixed", f"""
SELECT CAST(floor(speed_km_day / 5) AS BIGINT) AS bin, round(floor(speed_km_day / 5) * 5, 6) AS bin_lo,
       round((floor(speed_km_day / 5) + 1) * 5, 6) AS bin_hi, CAST(count(*) AS BIGINT) AS n
FROM ({SPEED_SQL}) WHERE speed_km_day > 0 GROUP BY 1, 2, 3""")
def histogram_fixed(spark, d):
    s = _speeds(spark, d).filter(F.col("speed_km_day") > 0)
    return rounded(St.histogram_fixed(s, "speed_km_day", 5.0), ["bin_lo", "bin_hi"])


@query("histogram_n", f"""
WITH s AS (SELECT speed_bodyL_secs AS x FROM ({SPEED_SQL}) WHERE speed_bodyL_secs > 0),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM s),
b AS (SELECT CAST(least(floor(coalesce((x - lo) / NULLIF(hi - lo, 0), 0) * 30) + 1, 30) AS BIGINT) AS bin, lo, hi FROM s, r)
SELECT bin, round(lo + (bin - 1) * ((hi - lo) / 30), 6) AS bin_lo, round(lo + bin * ((hi - lo) / 30), 6) AS bin_hi,
       CAST(count(*) AS BIGINT) AS n FROM b GROUP BY bin, lo, hi""")
def histogram_n(spark, d):
    s = _speeds(spark, d).filter(F.col("speed_bodyL_secs") > 0)
    return rounded(St.histogram_n(s, "speed_bodyL_secs", 30), ["bin_lo", "bin_hi"])


@query("bar_count", f"""
SELECT site, CAST(count(*) AS BIGINT) AS n FROM ({DUR_SQL}) WHERE duration > 72 GROUP BY site""")
def bar_count(spark, d):
    fl = A.first_last(T.detections(spark, d), ["tag", "site"], "ts", "hours")
    return A.count_rows(fl.filter(F.col("duration") > 72), ["site"])
