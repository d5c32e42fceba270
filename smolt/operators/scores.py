"""Score vector and observed information of survival models (survey 2.11).

The log-likelihood is linear in the sufficient statistics of ``survival``: at
most 4 x K numbers for each dataset and group. Its derivatives are array
expressions over them, in the JVM: chi backwards, then the forward recursion
``B_m = B_(m-1) phi_(m-1) (1 - p_m) + W_m / chi_m``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smolt.operators.designs import dot
from smolt.operators.survival import STATS, sufficient_stats

#: Step of the differences that give the information.
STEP = 1e-4


def stat_arrays(freq: DataFrame, group: str, k: int, extra: Sequence[str] = ()) -> DataFrame:
    """(extra..., group, s_phi, s_p1, s_p0, w): arrays by occasion."""
    s = sufficient_stats(freq, group, k, extra)
    rows = F.array_sort(F.collect_list(F.struct("occ", *STATS)))
    return s.groupBy(*extra, F.col(group).cast("string").alias(group)).agg(rows.alias("r")).select(
        *extra, group, *[F.col("r")[c].cast("array<double>").alias(c) for c in STATS])


def logit_score(df: DataFrame, k: int) -> DataFrame:
    """``df`` (columns of ``stat_arrays``, ``phi`` and ``p`` as arrays of
    K - 1 elements, p from occasion 2) with ``g_phi`` and ``g_p``: the
    derivatives of ln L in the logits of each element."""
    at = F.element_at
    phi, p, chi, flow = (F.col(c) for c in ("phi", "p", "__chi", "__flow"))
    steps = F.sequence(F.lit(1), F.lit(k - 1))
    back = F.aggregate(F.sequence(F.lit(k - 1), F.lit(1), F.lit(-1)), F.array(F.lit(1.0)), lambda acc, j: F.concat(
        F.array(1 - at(phi, j) + at(phi, j) * (1 - at(p, j)) * at(acc, F.lit(1))), acc))
    before = lambda m: F.greatest(m - 1, F.lit(1))
    forth = F.aggregate(steps, F.array().cast("array<double>"), lambda acc, m: F.concat(acc, F.array(
        F.when(m > 1, F.try_element_at(acc, before(m)) * at(phi, before(m)) * (1 - at(p, before(m)))).otherwise(0.0)
        + at(F.col("w"), m) / at(chi, m))))
    d = df.withColumn("__chi", back).withColumn("__flow", forth)
    g_phi = F.transform(steps, lambda m: (at(F.col("s_phi"), m) / at(phi, m) + at(flow, m) * (at(chi, m + 1) * (1 - at(p, m)) - 1))
                        * at(phi, m) * (1 - at(phi, m)))
    g_p = F.transform(steps, lambda m: (at(F.col("s_p1"), m + 1) / at(p, m) - at(F.col("s_p0"), m + 1) / (1 - at(p, m))
                                        - at(flow, m) * at(phi, m) * at(chi, m + 1)) * at(p, m) * (1 - at(p, m)))
    return d.withColumns({"g_phi": g_phi, "g_p": g_p}).drop("__chi", "__flow")


def cjs_score(freq: DataFrame, params: DataFrame, group: str, k: int, extra: Sequence[str] = ()) -> DataFrame:
    """(extra..., group, param, occasion, score): d ln L / d logit of every
    parameter of every group. ``params`` has phi (K - 1 elements) and p (K,
    the first unused), as for ``cjs_loglik``."""
    j = stat_arrays(freq, group, k, extra).join(params.withColumn("p", F.slice("p", 2, k - 1)), [*extra, group])
    d = logit_score(j, k)
    rows = lambda param, g, first: d.select(
        *extra, group, F.lit(param).alias("param"), F.posexplode(g).alias("i", "score")).withColumn("occasion", F.col("i") + first).drop("i")
    return rows("Phi", "g_phi", 1).unionByName(rows("p", "g_p", 2)).select(*extra, group, "param", "occasion", "score")


def beta_scores(stats: DataFrame, design: DataFrame, betas: DataFrame, group: str, k: int, by: Sequence[str]) -> DataFrame:
    """(by..., i, score): d ln L / d beta_i at the betas of every key.

    ``betas``: by... and ``beta``, an array. ``design`` has the key's
    columns dataset and model, ``stats`` dataset. Everything here has at most
    a few dozen rows for a key."""
    by = list(by)
    rows = design.select("dataset", "model", "param", group, "occasion", "x").join(betas, ["dataset", "model"])
    rows = rows.withColumn("real", 1 / (1 + F.exp(-dot(F.col("x"), F.col("beta")))))
    cell = F.struct("occasion", "real", "x")
    pick = lambda param: F.array_sort(F.collect_list(F.when(F.col("param") == param, cell)), lambda a, b: a["occasion"] - b["occasion"])
    rows = rows.groupBy(*by, group).agg(pick("Phi").alias("f"), pick("p").alias("q"))
    rows = rows.select(*by, group, F.transform("f", lambda c: c["real"]).alias("phi"), F.transform("q", lambda c: c["real"]).alias("p"),
                       F.concat(F.transform("f", lambda c: c["x"]), F.transform("q", lambda c: c["x"])).alias("xs"))
    d = logit_score(rows.join(stats, ["dataset", group]), k)
    parts = d.select(*by, F.explode(F.arrays_zip(F.concat("g_phi", "g_p").alias("g"), "xs")).alias("c"))
    parts = parts.select(*by, F.col("c.g").alias("g"), F.posexplode("c.xs").alias("i", "x"))
    return parts.groupBy(*by, F.col("i").alias("i")).agg(F.sum(F.col("g") * F.col("x")).alias("score"))


def fitted_score(freq: DataFrame, fits: DataFrame, design: DataFrame, group: str, k: int) -> DataFrame:
    """(dataset, model, beta_index, score, information): the score at fitted
    betas and the observed information's row, by differences of the score."""
    stats = stat_arrays(freq, group, k, ["dataset"])
    b = fits.groupBy("dataset", "model").agg(F.array_sort(F.collect_list(F.struct("beta_index", "estimate"))).alias("b")).select(
        "dataset", "model", F.transform("b", lambda r: r["estimate"]).alias("beta"))
    # direction 0 is the fit itself; j and -j move beta j up and down
    b = b.select("dataset", "model", F.explode(F.sequence(-F.size("beta"), F.size("beta"))).alias("move"), "beta")
    b = b.withColumn("beta", F.transform("beta", lambda v, i: v + F.when(F.abs("move") == i + 1, F.signum("move") * STEP).otherwise(0.0)))
    s = beta_scores(stats, design, b, group, k, ["dataset", "model", "move"])
    own = s.where("move = 0").select("dataset", "model", "i", "score")
    bend = s.where("move <> 0").groupBy("dataset", "model", "i", F.abs("move").alias("j")).agg(
        (-F.sum(F.signum("move") * F.col("score")) / (2 * STEP)).alias("h"))
    bend = bend.groupBy("dataset", "model", "i").agg(F.array_sort(F.collect_list(F.struct("j", "h"))).alias("h"))
    return own.join(bend, ["dataset", "model", "i"]).select(
        "dataset", "model", (F.col("i") + 1).alias("beta_index"), "score", F.transform("h", lambda r: r["h"]).alias("information"))
