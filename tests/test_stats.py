"""Group statistics: Welch t, t tail, Shapiro-Wilk, box plots."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from smolt.operators import stats as St


def _sw_local(x):
    """Single-node Shapiro-Wilk with the same published approximation."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    m = St.norm_ppf((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    mm = np.sum(m ** 2)
    u = 1 / math.sqrt(n)
    poly = lambda c, v: sum(ci * v ** i for i, ci in enumerate(c))
    an = m[-1] / math.sqrt(mm) + poly((0.0,) + St.SW_AN, u)
    an1 = m[-2] / math.sqrt(mm) + poly((0.0,) + St.SW_AN1, u)
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
    a = m / math.sqrt(phi)
    a[-1], a[0], a[-2], a[1] = an, -an, an1, -an1
    w = np.dot(a, x) ** 2 / np.sum((x - x.mean()) ** 2)
    lm = math.log(n)
    z = (math.log1p(-w) - poly(St.SW_LARGE_MEAN, lm)) / math.exp(poly(St.SW_LARGE_SD, lm))
    return w, 0.5 * math.erfc(z / math.sqrt(2))


def test_norm_ppf():
    for p, q in [(0.5, 0.0), (0.975, 1.959963984540054), (0.01, -2.326347874040841),
                 (0.999, 3.090232306167814)]:
        assert St.norm_ppf(np.array([p]))[0] == pytest.approx(q, abs=1e-8)


def test_t_tail():
    # two-sided 5% critical values of Student's t
    assert St.t_sf_two_sided(np.array([2.228138851986274]), np.array([10.0]))[0] == pytest.approx(0.05, abs=1e-9)
    assert St.t_sf_two_sided(np.array([1.959963984540054]), np.array([1e7]))[0] == pytest.approx(0.05, abs=1e-5)


def test_welch_matches_formula(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(78, 9, 15), rng.normal(91, 8, 7)
    rows = [("pump", float(v)) for v in a] + [("control", float(v)) for v in b] + [("pump", None)]
    df = spark.createDataFrame(rows, "grp string, hb double")
    r = St.welch_t_test(df, "hb", "grp", "pump", "control", with_p=True).collect()[0]
    va, vb = a.var(ddof=1) / 15, b.var(ddof=1) / 7
    t = (a.mean() - b.mean()) / math.sqrt(va + vb)
    dof = (va + vb) ** 2 / (va ** 2 / 14 + vb ** 2 / 6)
    assert r["t"] == pytest.approx(t) and r["df"] == pytest.approx(dof)
    assert 0 < r["p_value"] < 0.05


def test_shapiro_distributed_equals_local(spark):
    rng = np.random.default_rng(7)
    norm, expo = rng.normal(0, 1, 400), rng.exponential(1, 300)
    rows = [("norm", float(v)) for v in norm] + [("expo", float(v)) for v in expo]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r for r in St.shapiro_wilk(df, "x", ["g"]).collect()}
    for g, x in (("norm", norm), ("expo", expo)):
        w, p = _sw_local(x)
        assert got[g]["W"] == pytest.approx(w, abs=1e-9)
        assert got[g]["p_value"] == pytest.approx(p, rel=1e-6)
    assert got["norm"]["p_value"] > 0.01 and got["expo"]["p_value"] < 1e-6


def test_boxplot_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 100.0]
    df = spark.createDataFrame([("a", v) for v in vals], "g string, v double")
    r = St.boxplot_stats(df, "v", ["g"]).collect()[0]
    q1, q2, q3 = np.quantile(vals, [0.25, 0.5, 0.75])
    assert (r["lower"], r["middle"], r["upper"]) == (q1, q2, q3)
    assert r["ymax"] == 8.0 and r["ymin"] == 1.0 and r["n_outliers"] == 1


def test_shapiro_small_groups(spark):
    rows = [("three", 1.0), ("three", 2.0), ("three", 4.0)] + \
           [("five", v) for v in (2.1, 3.3, 1.0, 7.5, 4.2)] + [("two", 1.0), ("two", 2.0)] + \
           [("one", 4.0)]
    got = {r["g"]: r for r in St.shapiro_wilk(spark.createDataFrame(rows, "g string, x double"),
                                               "x", ["g"]).collect()}
    # n = 3: W = a^2 (x3 - x1)^2 / SS with a = sqrt(1/2)
    x = np.array([1.0, 2.0, 4.0])
    assert got["three"]["W"] == pytest.approx(0.5 * 9 / np.sum((x - x.mean()) ** 2))
    assert got["two"]["W"] is None and got["two"]["p_value"] is None
    assert got["one"]["W"] is None and got["one"]["n"] == 1
    assert 0 < got["five"]["W"] <= 1 and 0 < got["five"]["p_value"] <= 1


def test_quantiles_are_exact(spark):
    from smolt.operators.aggregates import exact_quantiles
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(0, 1, 101), "b": rng.integers(-3, 3, 1000) * 1.0, None: rng.lognormal(0, 9, 500),
              "e": np.full(7, 2.5), "f": 1e5 + rng.normal(0, 1e-3, 333), "g": np.array([-1e300, 1e-300, 0.0, -0.0, 5e-324])}
    rows = [(g, float(v)) for g, x in values.items() for v in x] + [("c", 1.0), ("c", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    probs, names = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0], list("uvwxyz")
    got = {r["g"]: [r[n] for n in names] for r in exact_quantiles(df, "x", ["g"], probs, names).collect()}
    assert got.keys() == {*values, "c"}
    for g, x in {**values, "c": [1.0]}.items():
        s, want = np.sort(x), []
        for p in probs:
            h = (len(s) - 1) * p + 1
            lo = int(np.floor(h))
            hi = min(lo + 1, len(s))
            want.append(s[lo - 1] + (h - lo) * (s[hi - 1] - s[lo - 1]))
        assert got[g] == want, g
    one = exact_quantiles(df.filter("g = 'b'"), "x", [], [0.5], ["m"]).collect()
    assert [r["m"] for r in one] == [float(np.median(values["b"]))]


def test_row_numbers_with_a_payload(spark):
    """Numbers are 1..N in order, for rows wider than the key, with exchange
    reuse off."""
    from smolt.operators.sorting import global_row_number
    n = 2_000_000
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        d = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pay"))
        r = global_row_number(d, ["k"], "row_id")
        assert r.filter(F.col("row_id") != F.col("k") + 1).count() == 0 and r.count() == n
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_shapiro_single_sample(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(5, 2, 250)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    r = St.shapiro_wilk(df, "x", []).collect()
    assert len(r) == 1 and r[0]["n"] == 250
    w, p = _sw_local(x)
    assert r[0]["W"] == pytest.approx(w, abs=1e-9) and r[0]["p_value"] == pytest.approx(p, rel=1e-6)


def test_checked_broadcast(spark):
    from smolt.operators.joins import checked_broadcast, join_dim
    from smolt.sources.tables import sites
    dim = sites(spark)
    big = spark.range(10 ** 9).select(F.when(F.col("id") % 2 == 0, "view").otherwise("click").alias("site"), "id")
    plan = join_dim(big, dim, "site")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan
    # above the limit, or with broadcasts off, no hint is added
    huge = spark.range(10 ** 9)
    assert checked_broadcast(huge, max_bytes=1024) is huge
    for value, hinted in (("-1", False), ("10MB", True)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", value)
        try:
            assert (checked_broadcast(dim) is not dim) == hinted
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_welch_interval(spark):
    """Against the interval's definition: the t test of the difference less
    either end gives p = 0.05."""
    rng = np.random.default_rng(7)
    a, b = rng.normal(5, 2, 40), rng.normal(6, 3, 25)
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "g string, x double")
    r = St.welch_t_test(df, "x", "g", "a", "b", with_p=True).collect()[0]
    assert r["estimate"] == pytest.approx(a.mean() - b.mean())
    se = r["estimate"] / r["t"]
    for end in (r["conf_low"], r["conf_high"]):
        t = np.array([(r["estimate"] - end) / se])
        assert St.t_sf_two_sided(t, np.array([r["df"]]))[0] == pytest.approx(0.05, abs=1e-9)
    assert (r["conf_low"] < 0 < r["conf_high"]) == (r["p_value"] > 0.05)
    # fixed value: the 97.5% point of t with 10 degrees of freedom
    assert St.t_quantile(np.array([10.0]))[0] == pytest.approx(2.2281388520, abs=1e-8)
