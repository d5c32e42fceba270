"""Group statistics (survey 2.10).

Everything reducible to sums is an aggregate (``welch_t_test``, box-plot
statistics, histograms). Shapiro-Wilk needs the rank of each value within
its group; ranks come from the skew-bounded row numbering in ``windows``
and the coefficients from Royston's (1992) approximation, so no group is
ever collected into one task. Normal quantiles and tails and the t
distribution are column expressions (``functions/distributions.py``); the
numpy forms here are for local arrays.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smolt.functions import distributions as D


# ---------------------------------------------------------------- Welch t

def welch_t_test(df: DataFrame, value: str, group: str, first: str, second: str,
                 with_p: bool = False) -> DataFrame:
    """Two-sided Welch two-sample t test of ``value`` between two groups.

    ``t = (m1 - m2) / sqrt(v1/n1 + v2/n2)`` with Welch-Satterthwaite df;
    NULL values are dropped (``drop_na``). One aggregate pass, one row out;
    ``estimate`` is the difference of the means, and ``with_p`` adds the
    p-value and the 95% interval of the difference.
    """
    d = df.filter(F.col(value).isNotNull() & F.col(group).isin(first, second))
    g = d.groupBy().agg(*[e for lvl, tag in ((first, "a"), (second, "b")) for e in (
        F.count(F.when(F.col(group) == lvl, F.lit(1))).alias(f"n_{tag}"),
        F.avg(F.when(F.col(group) == lvl, F.col(value))).alias(f"mean_{tag}"),
        F.var_samp(F.when(F.col(group) == lvl, F.col(value))).alias(f"var_{tag}"))])
    se2a = F.try_divide(F.col("var_a"), F.col("n_a").cast("double"))
    se2b = F.try_divide(F.col("var_b"), F.col("n_b").cast("double"))
    # x / 0 (no spread in either group) gives NULL, not an ANSI error
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(se2a + se2b))
    dof = F.try_divide((se2a + se2b) ** 2,
                       F.try_divide(se2a ** 2, (F.col("n_a") - 1).cast("double"))
                       + F.try_divide(se2b ** 2, (F.col("n_b") - 1).cast("double")))
    out = g.select(F.lit(first).alias("group_a"), F.lit(second).alias("group_b"),
                   "n_a", "n_b", "mean_a", "mean_b", (F.col("mean_a") - F.col("mean_b")).alias("estimate"),
                   t.alias("t"), dof.alias("df"), F.sqrt(se2a + se2b).alias("__se"))
    if with_p:
        reach = D.t_reach(F.col("df")) * F.col("__se")
        out = out.withColumns({"p_value": D.t_two_sided(F.col("t"), F.col("df")),
                               "conf_low": F.col("estimate") - reach, "conf_high": F.col("estimate") + reach})
    return out.drop("__se")


def _betacf(a, b, x, iters=300):
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < tiny, tiny, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        de = d * c
        h *= de
        if np.all(np.abs(de - 1.0) < 1e-15):
            break
    return h


def _betainc(a, b, x):
    """Regularised incomplete beta I_x(a, b), vectorised."""
    x = np.clip(x, 0.0, 1.0)
    lbeta = np.vectorize(lambda p, q: math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q))(a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(np.where(x > 0, x, 1)) + b * np.log(np.where(x < 1, 1 - x, 1)) - lbeta)
    swap = x > (a + 1.0) / (a + b + 2.0)
    xa = np.where(swap, 1 - x, x)
    pa, pb = np.where(swap, b, a), np.where(swap, a, b)
    cf = _betacf(pa, pb, xa)
    val = front * cf / pa
    res = np.where(swap, 1.0 - val, val)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, res))


def t_sf_two_sided(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(|T| > |t|) for Student's t: I_{df/(df+t^2)}(df/2, 1/2)."""
    t = np.asarray(t, dtype=float)
    dof = np.asarray(dof, dtype=float)
    x = dof / (dof + t * t)
    return _betainc(dof / 2.0, np.full_like(dof, 0.5), x)


def t_quantile(dof: np.ndarray, level: float = 0.95) -> np.ndarray:
    """|t| beyond which a share ``1 - level`` of Student's t lies (bisection)."""
    lo, hi = np.zeros_like(dof), np.full_like(dof, 1e6)
    for _ in range(200):
        mid = (lo + hi) / 2
        over = t_sf_two_sided(mid, dof) > 1 - level
        lo, hi = np.where(over, mid, lo), np.where(over, hi, mid)
    return (lo + hi) / 2


# ---------------------------------------------------------------- box plots

def boxplot_stats(df: DataFrame, value: str, by: Sequence[str], coef: float = 1.5) -> DataFrame:
    """Data behind a box plot per group.

    Hinges are exact type-7 quantiles (``exact_quantiles``); whiskers are
    the most extreme values inside ``coef * IQR`` of the hinges; values
    beyond are counted as outliers, in one more read of the table. There the
    rows of a large group meet their hinges where they are read and shrink
    to one row a task; a smaller group's values meet them after the shuffle.
    """
    from smolt.operators.aggregates import _join_by_keys, _key_join, _ranked, _sketched
    by = list(by)
    hinges, probs = ["lower", "middle", "upper"], [0.25, 0.5, 0.75]
    q = _ranked(df, value, by, _sketched(df, value, by, probs), probs, hinges)
    x, v = F.col("__x"), F.col("__v")
    reach = F.lit(coef) * (F.col("upper") - F.col("lower"))

    def inside(c: Column) -> Column:
        return (c >= F.col("lower") - reach) & (c <= F.col("upper") + reach)

    rows = _key_join(df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__x")), q, by, hinges)
    parts = rows.groupBy(*by, F.when(F.col("lower").isNull(), x).alias("__v")).agg(
        F.count(F.lit(1)).alias("__c"), F.min(F.when(inside(x), x)).alias("__lo"), F.max(F.when(inside(x), x)).alias("__hi"),
        F.count(F.when(~inside(x), F.lit(1))).alias("__out"))
    out = F.when(v.isNull(), F.col("__out")).when(inside(v), F.lit(0)).otherwise(F.col("__c"))
    return _join_by_keys(parts, q.drop("__n"), by).groupBy(*by).agg(
        F.coalesce(F.sum("__c"), F.lit(0)).alias("n"), F.min(F.coalesce("__lo", F.when(inside(v), v))).alias("ymin"),
        *[F.first(c).alias(c) for c in hinges], F.max(F.coalesce("__hi", F.when(inside(v), v))).alias("ymax"),
        F.coalesce(F.sum(out), F.lit(0)).alias("n_outliers"))


# ---------------------------------------------------------------- histograms

def histogram_fixed(df: DataFrame, value: str, width: float, origin: float = 0.0,
                    by: Sequence[str] = ()) -> DataFrame:
    """Counts per bin ``[origin + k*width, origin + (k+1)*width)``."""
    k = F.floor((F.col(value) - F.lit(origin)) / F.lit(width)).cast("long")
    d = df.filter(F.col(value).isNotNull()).withColumn("bin", k)
    g = d.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    return g.select(*by, "bin", (F.lit(origin) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                    (F.lit(origin) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"), "n")


def histogram_n(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """``bins`` equal-width bins over [min, max] (the maximum falls in the
    last bin): ``bin = min(floor((x - lo) / (hi - lo) * bins) + 1, bins)``.

    The range comes from scalar subqueries (one-row aggregates planned
    into the same job), so no row goes through the driver.
    """
    d = df.filter(F.col(value).isNotNull())
    lo = d.select(F.min(value)).scalar()
    hi = d.select(F.max(value)).scalar()
    # all values equal (hi == lo): a single bin
    frac = F.coalesce(F.try_divide(F.col(value) - lo, hi - lo), F.lit(0.0))
    b = F.least(F.floor(frac * F.lit(bins)) + 1, F.lit(bins)).cast("long")
    g = d.withColumn("bin", b).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    width = (hi - lo) / F.lit(bins)
    return g.select("bin", (lo + (F.col("bin") - 1) * width).alias("bin_lo"),
                    (lo + F.col("bin") * width).alias("bin_hi"), "n")


# ---------------------------------------------------------------- Shapiro-Wilk
# Polynomial coefficients of Royston's (1992, 1995)
# approximation to the Shapiro-Wilk coefficients and to the null
# distribution of W, as published.
SW_AN = (0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
SW_AN1 = (0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SW_SMALL_GAMMA = (-2.273, 0.459)
SW_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
SW_SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
SW_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
SW_LARGE_SD = (-0.4803, -0.082676, 0.0030302)

def norm_ppf(p: np.ndarray) -> np.ndarray:
    """Standard normal quantile, vectorised (relative error ~1e-9)."""
    p = np.asarray(p, dtype=float)
    out = np.full_like(p, np.nan)
    lo, hi = p < 0.02425, p > 1 - 0.02425
    mid = ~lo & ~hi & (p > 0) & (p < 1)
    q = p[mid] - 0.5
    r = q * q
    a, b = D.QUANTILE_A, D.QUANTILE_B
    out[mid] = ((((((a[0] * r + a[1]) * r + a[2]) * r + a[3]) * r + a[4]) * r + a[5]) * q
                / (((((b[0] * r + b[1]) * r + b[2]) * r + b[3]) * r + b[4]) * r + 1))
    c, d = D.QUANTILE_C, D.QUANTILE_D
    for mask, sign in ((lo & (p > 0), 1.0), (hi & (p < 1), -1.0)):
        pp = p[mask] if sign > 0 else 1 - p[mask]
        q = np.sqrt(-2 * np.log(pp))
        out[mask] = sign * ((((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5])
                            / ((((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1))
    return out


def _poly(coefs, x: Column) -> Column:
    acc = F.lit(0.0)
    for i, c in enumerate(coefs):
        acc = acc + F.lit(c) * (x ** i if i else F.lit(1.0))
    return acc


def shapiro_wilk(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Shapiro-Wilk W and p-value per group (Royston's approximation).

    Distributed, with one shuffle of the data (the range sort):

    1. A range-partitioned global row number over (group, value) ranks
       every value (a hot group is spread over many tasks).
    2. One aggregate per group gives n, the variance and the group's rank
       offset (its smallest row number); Blom scores ``m_i`` of the rank
       within the group are a column expression.
    3. One aggregate per group collects sum m_i^2, sum m_i x_i over the
       middle ranks and the four extreme values; W and its p-value are
       then column expressions on the group table.

    NULLs are dropped; groups with fewer than three values get NULL. R
    refuses n > 5000; here W and p are still computed with the same
    approximation.
    """
    from smolt.operators.sorting import global_row_number
    user_by = list(by)
    # a single sample is one group with a constant key (no cross join)
    by = user_by or ["__all"]
    src = df if user_by else df.withColumn("__all", F.lit(0))
    d = src.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__x"))
    ranked = global_row_number(d, [*by, "__x"], "__rid")
    # group size, variance and rank offset (smallest row number - 1) in one
    # aggregate over the ranked rows
    g = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.var_samp("__x").alias("__var"),
                                (F.min("__rid") - 1).alias("__before"))
    from smolt.operators.aggregates import _join_by_keys
    r = _join_by_keys(ranked, g.select(*by, "n", "__before"), by)
    nn = F.col("n")
    n = nn.cast("double")
    i = F.col("__rid") - F.col("__before")
    r = r.withColumn("__i", i).withColumn("__m", D.norm_quantile((F.col("__i") - 0.375) / (n + 0.25)))
    big = nn > 5
    special = (F.col("__i") == 1) | (F.col("__i") == nn) | \
        (big & ((F.col("__i") == 2) | (F.col("__i") == nn - 1)))
    ext = lambda k: F.max(F.when(F.col("__i") == k, F.col("__x")))
    s = r.groupBy(*by).agg(
        F.sum(F.col("__m") ** 2).alias("__mm"),
        F.sum(F.when(~special, F.col("__m") * F.col("__x")).otherwise(0.0)).alias("__mid"),
        ext(1).alias("__x1"), ext(2).alias("__x2"), ext(nn - 1).alias("__xn1"), ext(nn).alias("__xn"))
    g = _join_by_keys(g, s, by)
    g = g.withColumns({"__mn": D.norm_quantile((n - 0.375) / (n + 0.25)),
                       "__mn1": D.norm_quantile((n - 1.375) / (n + 0.25)), "__u": 1 / F.sqrt(n)})
    u, mm = F.col("__u"), F.col("__mm")
    # groups below three values get NULL throughout (no division errors)
    an = F.when(nn == 3, F.lit(math.sqrt(0.5))).otherwise(
        F.try_divide(F.col("__mn"), F.sqrt(mm)) + _poly((0.0,) + SW_AN, u))
    an1 = F.try_divide(F.col("__mn1"), F.sqrt(mm)) + _poly((0.0,) + SW_AN1, u)
    g = g.withColumns({"__an": an, "__an1": an1})
    phi = F.when(big, F.try_divide(mm - 2 * F.col("__mn") ** 2 - 2 * F.col("__mn1") ** 2,
                                   1 - 2 * F.col("__an") ** 2 - 2 * F.col("__an1") ** 2)) \
        .otherwise(F.try_divide(mm - 2 * F.col("__mn") ** 2, 1 - 2 * F.col("__an") ** 2))
    g = g.withColumn("__phi", phi)
    ax = (F.try_divide(F.col("__mid"), F.sqrt(F.col("__phi")))
          + F.col("__an") * (F.col("__xn") - F.col("__x1"))
          + F.when(big, F.col("__an1") * (F.col("__xn1") - F.col("__x2"))).otherwise(F.lit(0.0)))
    # n == 3: the middle coefficient is 0 (symmetric scores)
    ax = F.when(nn == 3, F.lit(math.sqrt(0.5)) * (F.col("__xn") - F.col("__x1"))).otherwise(ax)
    ss = F.col("__var") * (nn - 1)
    w = g.withColumn("W", F.when(nn >= 3, F.least(F.try_divide(ax ** 2, ss), F.lit(1.0))))
    ln_n = F.log(n)
    z_large = (F.log1p(-F.col("W")) - _poly(SW_LARGE_MEAN, ln_n)) / F.exp(_poly(SW_LARGE_SD, ln_n))
    gamma = _poly(SW_SMALL_GAMMA, n)
    z_small = (-F.log(gamma - F.log1p(-F.col("W"))) - _poly(SW_SMALL_MEAN, n)) \
        / F.exp(_poly(SW_SMALL_SD, n))
    w = w.withColumn("__z", F.when(nn >= 12, z_large).when(nn >= 4, z_small))
    p3 = F.greatest(F.lit(6 / math.pi) * (F.asin(F.sqrt(F.col("W"))) - F.asin(F.sqrt(F.lit(0.75)))),
                    F.lit(0.0))
    pval = F.when(nn == 3, p3).when(nn >= 4, D.norm_upper(F.col("__z")))
    return w.select(*user_by, nn.cast("long").alias("n"), "W", pval.alias("p_value"))
