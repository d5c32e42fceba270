"""Normal and Student distributions as column expressions, all in the JVM.

Fixed values: coefficients of published rational approximations, as printed
there (normal quantile: Acklam; normal tail: Hart's form as given by West;
ln gamma: Lanczos, g = 7).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normal quantile, middle and tails (numerators, denominators).
QUANTILE_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
              1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
QUANTILE_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
              6.680131188771972e+01, -1.328068155288572e+01, 1.0)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
              -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
              3.754408661907416e+00, 1.0)
QUANTILE_CUT = 0.02425
# Normal tail below 7.07 (numerator, denominator).
TAIL_N = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_D = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
          793.826512519948, 440.413735824752)
TAIL_CUT = 7.07106781186547
# Ln gamma.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)

#: Terms of the continued fraction; Newton steps of a quantile; degrees of freedom from which a t value counts as normal.
TERMS, NEWTON, NORMAL_DF = 300, 12, 1e6


def horner(coefs: Sequence[float], x: Column) -> Column:
    """Polynomial, highest power first."""
    out = F.lit(float(coefs[0]))
    for c in coefs[1:]:
        out = out * x + F.lit(float(c))
    return out


def norm_quantile(p: Column) -> Column:
    """Standard normal quantile (relative error about 1e-9); NULL outside (0, 1)."""
    q, low = p - 0.5, p < QUANTILE_CUT
    r = q * q
    middle = horner(QUANTILE_A, r) * q / horner(QUANTILE_B, r)
    s = F.sqrt(-2 * F.log(F.when(low, p).otherwise(1 - p)))
    tail = horner(QUANTILE_C, s) / horner(QUANTILE_D, s)
    return F.when((p > 0) & (p < 1), F.when(low, tail).when(p > 1 - QUANTILE_CUT, -tail).otherwise(middle))


def norm_upper(z: Column) -> Column:
    """P(Z > z)."""
    x = F.abs(z)
    fraction = x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))
    near, far = horner(TAIL_N, x) / horner(TAIL_D, x), 1 / (fraction * math.sqrt(2 * math.pi))
    tail = F.when(x > 37, F.lit(0.0)).otherwise(F.exp(-x * x / 2) * F.when(x < TAIL_CUT, near).otherwise(far))
    return F.when(z > 0, tail).otherwise(1 - tail)


def ln_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0.5."""
    x = z - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (x + i)
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * F.log(t) - t + F.log(series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, by Lentz: one
    step of the aggregate for each of its terms."""
    safe = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def turned(s: Column, i: Column) -> Column:
        """The next c and d, in one array."""
        m = F.floor((i + 1) / 2).cast("double")
        k = F.when(i % 2 == 1, m * (b - m) / ((a - 1 + 2 * m) * (a + 2 * m))).otherwise(-(a + m) * (a + b + m) / ((a + 2 * m) * (a + 1 + 2 * m))) * x
        return F.transform(F.array(k), lambda v: F.struct(safe(1 + v / s["c"]).alias("c"), (1 / safe(1 + v * s["d"])).alias("d")))

    def step(s: Column, i: Column) -> Column:
        return F.element_at(F.transform(turned(s, i), lambda n: state(n["c"], n["d"], s["h"] * n["c"] * n["d"])), 1)

    d0 = 1 / safe(1 - (a + b) * x / (a + 1))
    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * TERMS)), state(F.lit(1.0), d0, d0), step, lambda s: s["h"])


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| > |t|) of Student's t: the incomplete beta function
    I_x(dof / 2, 1 / 2) at x = dof / (dof + t^2)."""
    x = dof / (dof + t * t)
    a, b = dof / 2, F.lit(0.5)
    front = F.exp(a * F.log(x) + b * F.log1p(-x) + ln_gamma(a + 0.5) - ln_gamma(a) - 0.5 * math.log(math.pi))
    left = front * _fraction(a, b, x) / a
    right = 1 - front * _fraction(b, a, 1 - x) / b
    exact = F.when(t == 0, F.lit(1.0)).when(x > (a + 1) / (a + 2.5), right).otherwise(left)
    normal = 2 * norm_upper(F.abs(t) * (1 - 1 / (4 * dof)) / F.sqrt(1 + t * t / (2 * dof)))
    return F.when(t.isNotNull() & (dof > 0), F.when(dof >= NORMAL_DF, normal).otherwise(exact))


def t_reach(dof: Column, level: float = 0.95) -> Column:
    """The t value that |T| exceeds with probability 1 - ``level``, by
    Newton's method from the normal one: the tail is convex, so the steps
    come from below and never overshoot."""
    half = F.exp(ln_gamma(dof / 2 + 0.5) - ln_gamma(dof / 2)) / F.sqrt(dof * math.pi)
    density = lambda t: 2 * half * F.pow(1 + t * t / dof, -(dof + 1) / 2)
    start = F.lit(NormalDist().inv_cdf((1 + level) / 2))
    return F.when(dof > 0, F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON)), start, lambda t, _: t + (t_two_sided(t, dof) - (1 - level)) / density(t)))
