"""Distribution columns against the standard library and numeric integrals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from smolt.functions import distributions as D


def column(spark, values, expr, schema="x double"):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + schema)
    return [r["y"] for r in rows.select("i", expr.alias("y")).orderBy("i").collect()]


def test_normal_quantile_and_tail(spark):
    from statistics import NormalDist
    p = [1e-12, 1e-5, 0.02, 0.02425, 0.1, 0.5, 0.77, 0.98, 1 - 1e-6]
    assert column(spark, p, D.norm_quantile(F.col("x"))) == pytest.approx([NormalDist().inv_cdf(v) for v in p], rel=2e-9, abs=1e-9)
    assert column(spark, [0.0, 1.0, -1.0, None], D.norm_quantile(F.col("x"))) == [None] * 4
    z = [-40.0, -8.0, -1.5, 0.0, 0.3, 2.0, 7.0, 7.2, 20.0, 36.0]
    assert column(spark, z, D.norm_upper(F.col("x"))) == pytest.approx([0.5 * math.erfc(v / math.sqrt(2)) for v in z], rel=1e-7, abs=1e-320)


def test_ln_gamma(spark):
    z = [0.6, 1.0, 2.5, 10.0, 7500.25, 1e6]
    assert column(spark, z, D.ln_gamma(F.col("x"))) == pytest.approx([math.lgamma(v) for v in z], rel=1e-13, abs=1e-13)


def by_integral(t, dof):
    """Simpson over the angle atan(t / sqrt(dof))."""
    a = math.atan(abs(t) / math.sqrt(dof))
    h = np.linspace(a, math.pi / 2, 2_000_001)
    y = np.cos(h) ** (dof - 1)
    w = np.full(len(h), 2.0)
    w[1::2], w[0], w[-1] = 4.0, 1.0, 1.0
    return 2 * (y @ w) * (h[1] - h[0]) / 3 * math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi)


def test_student_tail_and_quantile(spark):
    cases = [(0.0, 5.0), (1.0, 1.0), (-2.228138851986274, 10.0), (3.3, 8.537), (0.2, 300.5), (2.5, 15000.0), (8.0, 40.0)]
    got = column(spark, cases, D.t_two_sided(F.col("t"), F.col("d")), "t double, d double")
    assert got == pytest.approx([by_integral(*c) if c[0] else 1.0 for c in cases], rel=1e-8)
    big = column(spark, [(1.7, 999_999.0), (1.7, 1_000_001.0)], D.t_two_sided(F.col("t"), F.col("d")), "t double, d double")
    assert big[0] == pytest.approx(big[1], rel=1e-6)
    assert column(spark, [(None, 5.0), (1.0, None), (1.0, 0.0)], D.t_two_sided(F.col("t"), F.col("d")), "t double, d double") == [None] * 3
    assert column(spark, [1.0, 10.0, 1e7], D.t_reach(F.col("x"))) == pytest.approx([12.7062047362, 2.2281388520, 1.9599643], rel=1e-7)
