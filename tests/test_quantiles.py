"""Exact quantiles against sorting: infinities, NaN, ties, one hot group."""

import math

import numpy as np
import pytest

from smolt.operators import aggregates as A
from smolt.operators.stats import boxplot_stats

PROBS, NAMES = [0.0, 0.25, 0.5, 0.9, 1.0], ["q0", "q25", "q50", "q90", "q100"]


def by_sorting(values, p):
    """Type 7, NaN above the infinities."""
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    h = (len(v) - 1) * p
    a, b = v[math.floor(h)], v[min(math.floor(h) + 1, len(v) - 1)]
    return a if a == b or math.isnan(a) else a + (h - math.floor(h)) * (b - a)


def same(got, want):
    return (math.isnan(got) and math.isnan(want)) or got == pytest.approx(want, rel=1e-12)


def data(kind, rng):
    inf = math.inf
    return {"small": lambda: [1.0, 2.0, inf], "negative": lambda: [-inf, -inf, 3.0, 0.0, -0.0], "nan": lambda: [math.nan, 1.0, inf, -inf, 5e-324],
            "one": lambda: [7.0], "infinite": lambda: [inf, inf, inf], "ties": lambda: [2.0] * 50 + [3.0] * 51,
            "tiny": lambda: [5e-324 * i for i in range(9)], "wide": lambda: (rng.normal(size=301) * 10.0 ** rng.integers(-300, 300, 301)).tolist()}[kind]()


def test_groups_of_every_kind(spark):
    rng = np.random.default_rng(0)
    kinds = ["small", "negative", "nan", "one", "infinite", "ties", "tiny", "wide"]
    groups = {k: data(k, rng) for k in kinds} | {None: [4.0, 1.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("empty", None), ("one", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r for r in A.exact_quantiles(df, "x", ["g"], PROBS, NAMES).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for p, n in zip(PROBS, NAMES):
            assert same(got[g][n], by_sorting(vs, p)), (g, n, got[g][n], by_sorting(vs, p))


@pytest.mark.parametrize("by", [["g"], []])
def test_large_groups_are_bracketed_by_the_sketch(spark, by):
    """More rows than the sketch is exact for: a hot group, heavy ties, infinities."""
    rng = np.random.default_rng(1)
    n = 3 * A.ACCURACY
    x = np.concatenate([rng.lognormal(0, 3, n), rng.integers(0, 4, n).astype(float), [math.inf] * 30_000, [-math.inf] * 7])
    g = np.concatenate([np.repeat("hot", n), np.repeat("ties", n), np.repeat("hot", 30_007)])
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x}).sample(frac=1, random_state=2)).repartition(6)
    got = A.exact_quantiles(df, "x", by, PROBS, NAMES).collect()
    for r in got:
        own = x[g == r["g"]] if by else x
        for p, name in zip(PROBS, NAMES):
            assert same(r[name], by_sorting(own.tolist(), p)), name
    s = A.summarise_stats(df, by, "x").collect()
    assert len(s) == len(got) == (2 if by else 1)
    for r in s:
        own = x[g == r["g"]] if by else x
        assert same(r["median"], by_sorting(own.tolist(), 0.5)) and r["n"] == len(own) and r["max"] == own.max()


def test_groups_without_a_value(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), ("b", None), (None, 2.0)], "g string, x double")
    got = {r["g"]: (r["n"], r["min"], r["median"]) for r in A.summarise_stats(df, ["g"], "x").collect()}
    assert got == {"a": (2, None, None), "b": (2, 1.0, 1.0), None: (1, 2.0, 2.0)}
    one = A.summarise_stats(df.limit(0), [], "x").collect()[0]
    assert one["n"] == 0 and one["median"] is None
    assert A.summarise_stats(df.limit(0), ["g"], "x").collect() == []


def test_box_plot_with_infinite_values(spark):
    df = spark.createDataFrame([("a", v) for v in [1.0, 2.0, 3.0, 4.0, math.inf, -50.0]], "g string, x double")
    r = boxplot_stats(df, "x", ["g"]).collect()[0]
    assert (r["n"], r["ymin"], r["ymax"], r["n_outliers"]) == (6, 1.0, 4.0, 2)
    assert r["middle"] == 2.5 and r["lower"] == 1.25 and r["upper"] == 3.75


def test_the_input_is_read_twice(spark, tmp_path):
    spark.range(1000).selectExpr("id % 3 AS g", "cast(id AS double) AS x").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for out in (A.exact_quantiles(df, "x", ["g"], [0.5], ["m"]), A.summarise_stats(df, ["g"], "x")):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan ==")[0].count("FileScan parquet") == 2


def _before_the_first_exchange(df):
    """Per scan of the plan, the operators from it up to its first exchange."""
    lines = [(len(t) - len(t.lstrip(" :+-")), t.lstrip(" :+-")) for t in df._jdf.queryExecution().executedPlan().toString().splitlines()]
    for i, (depth, text) in enumerate(lines):
        if text.startswith("FileScan"):
            own = []
            for d, t in reversed(lines[:i]):
                if d < depth:
                    depth = d
                    if "Exchange" in t:
                        break
                    own.append(t)
            yield own


def test_rows_of_a_large_group_are_counted_where_they_are_read(spark, tmp_path):
    """No task gets a group's rows to sort or join; NULL and small groups beside a hot one."""
    rng = np.random.default_rng(3)
    n = 2 * A.ACCURACY
    groups = {"hot": np.concatenate([rng.normal(size=n), [99.0, -99.0]]), "small": rng.normal(size=101), None: np.array([1.0, 2.0, 3.0, 50.0]), "b": np.array([math.inf, 1.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("small", None)]
    import pandas as pd
    spark.createDataFrame(pd.DataFrame(rows, columns=["g", "x"]), "g string, x double").selectExpr("g", "nullif(x, 'NaN') AS x").repartition(4).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    box, stats = boxplot_stats(df, "x", ["g"]), A.summarise_stats(df, ["g"], "x")
    for out in (box, stats, A.exact_quantiles(df, "x", ["g"], PROBS, NAMES)):
        scans = list(_before_the_first_exchange(out))
        assert scans and all(any("Aggregate" in t for t in own) and not any("Sort" in t for t in own) for own in scans)
    got, med = {r["g"]: r for r in box.collect()}, {r["g"]: r["median"] for r in stats.collect()}
    assert set(got) == set(groups) and set(med) == {*groups, "none"} and med["none"] is None
    for g, vs in groups.items():
        lo, mid, hi = (by_sorting(vs.tolist(), p) for p in (0.25, 0.5, 0.75))
        fits = vs[(vs >= lo - 1.5 * (hi - lo)) & (vs <= hi + 1.5 * (hi - lo))]
        r = got[g]
        assert (r["n"], r["n_outliers"]) == (len(vs), len(vs) - len(fits)) and same(r["middle"], mid) and same(med[g], mid)
        assert (r["ymin"], r["ymax"]) == ((fits.min(), fits.max()) if len(fits) else (None, None))
    one = boxplot_stats(df.where("g = 'small'"), "x", []).collect()[0]
    assert (one["n"], one["ymin"], one["n_outliers"]) == (101, got["small"]["ymin"], got["small"]["n_outliers"])
    assert boxplot_stats(df.limit(0), "x", []).collect()[0]["n"] == 0
