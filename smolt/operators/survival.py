"""Cormack-Jolly-Seber survival models on frequency tables (survey 2.11).

Spark does the data work: histories are reduced to (dataset, group, ch, n)
cells, models are a (dataset x model) product of small tables, and each
fit runs in ``groupBy(dataset, model).applyInPandas``. A fit's input is
one dataset's sufficient statistics, ``4 * groups * K`` numbers however
many animals or histories there are.
Many datasets (sites, years, bootstrap replicates) fit in parallel.

Likelihood (Lebreton et al. 1992): for a history first seen at f and last
at l, ``prod_{j=f}^{l-1} Phi_j * prod_{j=f+1}^{l} p_j^h_j (1-p_j)^(1-h_j)
* chi_l`` with ``chi_K = 1`` and ``chi_j = 1 - Phi_j + Phi_j (1 - p_{j+1})
chi_{j+1}``; parameters on the logit link, design by formula kind.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smolt.operators.histories import first_last_occ

#: Formula kinds: whether it has an intercept, and its factor. With an
#: intercept a factor's first level is the reference (treatment coding);
#: without one every level has a column (cell means).
TERMS = {"dot": (True, None), "group": (True, "group"), "time": (True, "time"),
         "-1+group": (False, "group"), "-1+time": (False, "time")}
KINDS = ("dot", "group", "time")
Z95 = 1.96  # the listing's 95% interval multiplier
#: Betas beyond this are boundary estimates (a rate within 0.0001 of 0 or 1);
#: curvature below this share of the largest is not estimable.
BOUND, FLAT = 9.21, 1e-5

FIT_SCHEMA = ("dataset string, model string, param string, beta_index int, label string, "
              "estimate double, se double, lcl double, ucl double, neg2lnl double, "
              "k int, n_betas int, converged boolean, iterations int, levels string, at_bound boolean, vcov array<double>")


# ------------------------------------------------------------ design

def occasions(param: str, k: int) -> list[int]:
    """Phi of interval j -> j+1 for j = 1..K-1, p of occasions 2..K."""
    return list(range(1, k)) if param == "Phi" else list(range(2, k + 1))


def design_terms(kind: str, levels: Sequence[str], occs: Sequence[int]) -> list[tuple]:
    """Columns of a formula kind: (name, factor or None, level)."""
    if kind not in TERMS:
        raise ValueError(f"unknown formula kind {kind!r}")
    intercept, factor = TERMS[kind]
    values = {"group": levels, "time": occs}.get(factor, [])
    return ([("(Intercept)", None, None)] if intercept else []) + [(f"{factor}{v}", factor, v) for v in values[int(intercept):]]


def design_rows(kind: str, param: str, levels: Sequence[str], k: int):
    """Labels and design matrix rows (group, occasion, x) for one parameter,
    ordered by group and occasion."""
    occs = occasions(param, k)
    terms = design_terms(kind, levels, occs)
    rows = [(g, t, [1.0 if f is None or {"group": g, "time": t}[f] == v else 0.0 for _, f, v in terms]) for g in levels for t in occs]
    return [f"{param}:{name}" for name, _, _ in terms], rows


def design_data(freq: DataFrame, group: str, k: int, extra: Sequence[str] = ()) -> DataFrame:
    """Parameter index (``make.design.data``): one row per parameter x
    group x cohort x occasion, with age = occasions since release.

    Built from the groups present in the data with array generators (the
    index has ``groups * K**2`` rows, independent of data size).
    """
    groups = freq.select(*extra, group).distinct()
    cohort = F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("cohort")
    g = groups.select(*extra, group, cohort)
    phi = g.select(*extra, group, "cohort", F.lit("Phi").alias("param"),
                   F.explode(F.sequence(F.col("cohort"), F.lit(k - 1))).alias("occasion"))
    p = g.select(*extra, group, "cohort", F.lit("p").alias("param"),
                 F.explode(F.sequence(F.col("cohort") + 1, F.lit(k))).alias("occasion"))
    out = phi.unionByName(p)
    return out.withColumn("age", (F.col("occasion") - F.col("cohort")).cast("int"))


# ------------------------------------------------------------ likelihood as columns

def loglik_column(ch: Column, phi: Column, p: Column, k: int) -> Column:
    """ln P(history | first capture) with ``phi`` (array, length K-1,
    element j = Phi_j) and ``p`` (array, length K, element 1 unused)."""
    first, last = first_last_occ(ch, k)
    h = lambda j: F.substring(ch, j, 1) == F.lit("1")
    ph = lambda j: F.element_at(phi, j)
    pp = lambda j: F.element_at(p, j)
    surv = F.aggregate(F.sequence(F.lit(1), F.lit(k - 1)), F.lit(0.0),
                       lambda acc, j: acc + F.when((j >= first) & (j < last), F.log(ph(j)))
                       .otherwise(F.lit(0.0)))
    det = F.aggregate(F.sequence(F.lit(2), F.lit(k)), F.lit(0.0),
                      lambda acc, j: acc + F.when((j > first) & (j <= last),
                                                  F.log(F.when(h(j), pp(j)).otherwise(1 - pp(j))))
                      .otherwise(F.lit(0.0)))
    chi = F.aggregate(F.sequence(F.lit(k - 1), F.lit(1), F.lit(-1)), F.lit(1.0),
                      lambda acc, j: F.when(j >= last,
                                            1 - ph(j) + ph(j) * (1 - pp(j + 1)) * acc)
                      .otherwise(acc))
    return surv + det + F.log(chi)


def cjs_loglik(freq: DataFrame, params: DataFrame, group: str, k: int,
               extra: Sequence[str] = ()) -> DataFrame:
    """Sum of n * ln P(history) per dataset and group for given parameters.

    ``params`` has one row per (extra..., group) with array columns
    ``phi`` and ``p`` (see ``loglik_column``); it is small (one row per
    group) and joined on the group key.
    """
    j = freq.join(params, [*extra, group])
    ll = loglik_column(F.col("ch"), F.col("phi"), F.col("p"), k)
    return j.groupBy(*extra, group).agg(F.sum(F.col("n") * ll).alias("loglik"))


def constant_params(freq: DataFrame, group: str, k: int, phi: float, p: float,
                    extra: Sequence[str] = ()) -> DataFrame:
    """Parameter arrays with the same Phi and p on every occasion."""
    g = freq.select(*extra, group).distinct()
    return g.select(*extra, group,
                    F.array_repeat(F.lit(float(phi)), k - 1).alias("phi"),
                    F.concat(F.array(F.lit(None).cast("double")),
                             F.array_repeat(F.lit(float(p)), k - 1)).alias("p"))


def cjs_expected(freq: DataFrame, params: DataFrame, group: str, k: int,
                 extra: Sequence[str] = ()) -> DataFrame:
    """Expected count of each observed history x group: N_cohort x P(h)."""
    first, _ = first_last_occ(F.col("ch"), k)
    c = freq.withColumn("first_occ", first)
    tot = c.groupBy(*extra, group, "first_occ").agg(F.sum("n").alias("cohort_n"))
    j = c.join(tot, [*extra, group, "first_occ"]).join(params, [*extra, group])
    ll = loglik_column(F.col("ch"), F.col("phi"), F.col("p"), k)
    return j.select(*extra, group, "ch", "n", "cohort_n",
                    (F.col("cohort_n") * F.exp(ll)).alias("expected"))


def gof_stats(freq: DataFrame, params: DataFrame, group: str, k: int, n_params: DataFrame,
              extra: Sequence[str] = ()) -> DataFrame:
    """Deviance, Pearson chi-square, c-hat, s-bar and Fletcher c-hat.

    ``n_params`` gives k (estimable parameters) per dataset. Only observed
    histories are evaluated: a cohort of N animals first seen at occasion f
    has 2^(K-f) possible histories whose expected counts sum to N, so the
    unobserved ones add N less the observed expectations to Pearson's sum.
    """
    from smolt.operators.histories import cohorts as _cohorts, saturated_neg2lnl
    coh = _cohorts(freq, group, k, extra)
    obs = cjs_expected(freq, params, group, k, extra).select(
        *extra, F.col("n").alias("O"), F.col("cohort_n").alias("N"), F.col("expected").alias("E"))
    seen = obs.groupBy(*extra).agg(
        F.sum(F.col("O") * F.log(F.col("E") / F.col("N"))).alias("__ll"),
        F.count(F.lit(1)).alias("cells"),
        F.sum(F.try_divide((F.col("O") - F.col("E")) ** 2, F.col("E"))).alias("__chi"),
        F.sum("E").alias("__e"),
        F.sum(F.try_divide(F.col("O").cast("double"), F.col("E"))).alias("sum_o_over_e"))
    all_ = coh.groupBy(*extra).agg(F.sum("N").alias("__n"), F.sum(F.pow(F.lit(2.0), F.lit(k) - F.col("first_occ"))).alias("possible"))
    agg = seen.join(all_, list(extra)).withColumn("pearson_chisq", F.col("__chi") + F.col("__n") - F.col("__e"))
    ncoh = coh.groupBy(*extra).agg(F.count(F.lit(1)).alias("cohorts"))
    sat = saturated_neg2lnl(freq, group, k, extra)
    if not extra:
        raise ValueError("gof_stats needs a dataset key in `extra`")
    j = agg.join(ncoh, list(extra)).join(sat, list(extra)).join(n_params, list(extra))
    neg2 = F.lit(-2.0) * F.col("__ll")
    dev = neg2 - F.col("neg2lnl_sat")
    ddf = F.col("cells") - F.col("cohorts") - F.col("k")
    pdf = F.col("possible") - F.col("cohorts") - F.col("k")
    sbar = F.try_divide(F.col("sum_o_over_e") - F.col("possible"),
                        (F.col("possible") - F.col("cohorts")).cast("double"))
    dv = lambda a, b: F.try_divide(a, b.cast("double"))  # noqa: E731 (x/0 -> NULL)
    return j.select(*extra, neg2.alias("neg2lnl"), dev.alias("deviance"), ddf.alias("deviance_df"),
                    dv(dev, ddf).alias("c_hat"), "pearson_chisq", "possible", pdf.alias("pearson_df"),
                    dv(F.col("pearson_chisq"), pdf).alias("pearson_chat"), sbar.alias("s_bar"),
                    dv(dv(F.col("pearson_chisq"), pdf), 1 + sbar).alias("fletcher_chat"))


# ------------------------------------------------------------ numpy fitter

STATS = ("s_phi", "s_p1", "s_p0", "w")


def sufficient_stats(freq: DataFrame, group: str, k: int, extra: Sequence[str] = ()) -> DataFrame:
    """What a likelihood needs of a frequency table, per (group, occasion):
    survival intervals, detections and misses after first capture, and
    animals last seen there. At most K rows per group, however many
    histories there are; an aggregate with map-side combine."""
    first, last = first_last_occ(F.col("ch"), k)
    j = F.col("occ")
    seen = F.substring(F.col("ch"), j, F.lit(1)) == F.lit("1")
    span = (j > F.col("__f")) & (j <= F.col("__l"))
    x = (freq.withColumns({"__f": first, "__l": last})
             .select(*extra, group, "ch", "n", "__f", "__l", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("occ")))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0)))
    return x.groupBy(*extra, group, "occ").agg(
        total((j >= F.col("__f")) & (j < F.col("__l"))).alias("s_phi"), total(span & seen).alias("s_p1"),
        total(span & ~seen).alias("s_p0"), total(j == F.col("__l")).alias("w"))


def stats_of(pdf: pd.DataFrame, group: str, k: int) -> pd.DataFrame:
    """``sufficient_stats`` of a small local frequency table."""
    rows = []
    for ch, g, n in zip(pdf["ch"].astype(str), pdf[group], pdf["n"]):
        f, l_ = ch.index("1") + 1, ch.rindex("1") + 1
        for j in range(1, k + 1):
            span, seen = f < j <= l_, ch[j - 1] == "1"
            rows.append((g, j, n * (f <= j < l_), n * (span and seen), n * (span and not seen), n * (j == l_)))
    out = pd.DataFrame(rows, columns=[group, "occ", *STATS])
    return out.groupby([group, "occ"], as_index=False).sum()


class _Data:
    """Sufficient statistics of one dataset as (group, occasion) arrays.

    The log-likelihood is linear in them: S_phi[g, j] survival intervals,
    S_p1 / S_p0 detections / misses and W[g, l] animals last seen at l
    (which enter through ln chi_l). The optimiser works on at most
    4 * groups * K numbers, never on histories.
    """

    def __init__(self, stats: pd.DataFrame, group: str, levels: Sequence[str], k: int):
        self.k = k
        lv = {g: i for i, g in enumerate(levels)}
        at = ([lv[x] for x in stats[group]], stats["occ"].to_numpy() - 1)
        full = {c: np.zeros((len(levels), k)) for c in STATS}
        for c in STATS:
            np.add.at(full[c], at, stats[c].to_numpy(dtype=float))
        self.S_phi, self.S_p1, self.S_p0, self.W = full["s_phi"][:, :k - 1], full["s_p1"], full["s_p0"], full["w"]


def _real(beta, d: _Data, Xphi, Xp, G):
    k = d.k
    nphi = Xphi.shape[1]
    phi = 1.0 / (1.0 + np.exp(-(Xphi @ beta[:nphi]))).reshape(G, k - 1)
    pv = 1.0 / (1.0 + np.exp(-(Xp @ beta[nphi:]))).reshape(G, k - 1)
    return np.clip(phi, 1e-15, 1 - 1e-15), np.clip(pv, 1e-15, 1 - 1e-15)


def _chi(phi, pv, k):
    chi = np.ones((phi.shape[0], k))
    for j in range(k - 2, -1, -1):
        chi[:, j] = 1 - phi[:, j] + phi[:, j] * (1 - pv[:, j]) * chi[:, j + 1]
    return chi


def _neg_loglik(beta, d: _Data, Xphi, Xp, G):
    phi, pv = _real(beta, d, Xphi, Xp, G)
    chi = _chi(phi, pv, d.k)
    ll = (np.sum(d.S_phi * np.log(phi)) + np.sum(d.S_p1[:, 1:] * np.log(pv))
          + np.sum(d.S_p0[:, 1:] * np.log(1 - pv)) + np.sum(d.W * np.log(chi)))
    return -float(ll)


def _neg_grad(beta, d: _Data, Xphi, Xp, G):
    """Analytic gradient of -ln L in beta.

    With a_j = phi_j (1 - p_{j+1}) and B_m = sum_{l <= m} W_l / chi_l *
    prod_{q=l}^{m-1} a_q (a forward recursion), d ln L / d phi_m =
    S_phi/phi + B_m (chi_{m+1} (1 - p_{m+1}) - 1) and d ln L / d p_{m+1} =
    S_p1/p - S_p0/(1-p) - B_m phi_m chi_{m+1}; then the logit chain rule.
    """
    k = d.k
    phi, pv = _real(beta, d, Xphi, Xp, G)
    chi = _chi(phi, pv, k)
    a = phi * (1 - pv)
    B = np.zeros((G, k - 1))
    acc = np.zeros(G)
    for m in range(k - 1):
        acc = (acc * a[:, m - 1] if m > 0 else acc) + d.W[:, m] / chi[:, m]
        B[:, m] = acc
    dphi = d.S_phi / phi + B * (chi[:, 1:] * (1 - pv) - 1)
    dp = d.S_p1[:, 1:] / pv - d.S_p0[:, 1:] / (1 - pv) - B * phi * chi[:, 1:]
    gphi = Xphi.T @ (dphi * phi * (1 - phi)).ravel()
    gp = Xp.T @ (dp * pv * (1 - pv)).ravel()
    return -np.concatenate([gphi, gp])


def _hessian(grad, x, h=1e-5):
    m = len(x)
    H = np.zeros((m, m))
    for i in range(m):
        e = np.zeros(m)
        e[i] = h
        H[:, i] = (grad(x + e) - grad(x - e)) / (2 * h)
    return (H + H.T) / 2


def fit_cjs(stats: pd.DataFrame, group: str, levels: Sequence[str], k: int,
            phi_kind: str, p_kind: str, max_iter: int = 500, cap: float = 25.0,
            ftol: float = 1e-10):
    """``fit_cov`` without the covariances: (labels, beta, se, neg2lnl,
    k_estimable, converged, iterations)."""
    labels, beta, cov, *rest = fit_cov(stats, group, levels, k, phi_kind, p_kind, max_iter, cap, ftol)
    return labels, beta, np.sqrt(np.clip(np.diag(cov), 0, None)), *rest


def fit_cov(stats: pd.DataFrame, group: str, levels: Sequence[str], k: int,
            phi_kind: str, p_kind: str, max_iter: int = 500, cap: float = 25.0,
            ftol: float = 1e-10):
    """Maximum likelihood by damped Newton from zero betas.

    Returns (labels, beta, covariances, neg2lnl, k_estimable, converged,
    iterations).
    Analytic gradient, Hessian by central differences of the gradient.
    Non-identifiable betas make the Hessian singular: the step uses the
    eigen-decomposition with small eigenvalues floored, and k counts the
    eigenvalues above ``FLAT`` times the largest, so neither confounded
    betas nor boundary estimates (Phi = 1) count. Betas are capped at
    +-``cap``; fits with a boundary estimate are flagged ``at_bound``.
    """
    d = _Data(stats, group, levels, k)
    lphi, rphi = design_rows(phi_kind, "Phi", levels, k)
    lp, rp = design_rows(p_kind, "p", levels, k)
    Xphi = np.array([x for _, _, x in rphi])
    Xp = np.array([x for _, _, x in rp])
    G = len(levels)
    f = lambda b: _neg_loglik(b, d, Xphi, Xp, G)
    g = lambda b: _neg_grad(b, d, Xphi, Xp, G)
    beta = np.zeros(Xphi.shape[1] + Xp.shape[1])
    converged, it = False, 0
    f0 = f(beta)
    for it in range(1, max_iter + 1):
        gr = g(beta)
        H = _hessian(g, beta)
        w, V = np.linalg.eigh(H)
        w = np.maximum(np.abs(w), 1e-8 * max(1.0, np.abs(w).max()))
        step = -(V @ ((V.T @ gr) / w))
        t, f1 = 1.0, f0
        nb = beta
        while t > 1e-10:
            nb = np.clip(beta + t * step, -cap, cap)
            f1 = f(nb)
            if f1 <= f0:
                break
            t /= 2
        if f1 > f0:
            converged = True  # no descent direction left
            break
        moved = np.max(np.abs(nb - beta))
        beta, gain, f0 = nb, f0 - f1, f1
        if moved < 1e-10 or gain < ftol * max(1.0, abs(f0)) or np.max(np.abs(g(beta))) < 1e-8:
            converged = True
            break
    H = _hessian(g, beta)
    w, V = np.linalg.eigh(H)
    tol = FLAT * max(np.abs(w).max(), 1e-12)
    keep = w > tol
    kest = int(keep.sum())
    cov = (V[:, keep] / w[keep]) @ V[:, keep].T
    return lphi + lp, beta, cov, 2.0 * f(beta), kest, converged, it


def fit_models(freq: DataFrame, group: str, levels: Sequence[str], k: int,
               models: Sequence[tuple[str, str]], dataset: str = "dataset") -> DataFrame:
    """Fit every (Phi kind, p kind) model to every dataset in parallel.

    ``freq`` has (dataset, group, ch, n). The (dataset x model) product is
    formed by exploding a literal model array (no join), then one
    ``applyInPandas`` task per (dataset, model) fits its sufficient
    statistics: at most K rows per group. A group level that is not declared
    in ``levels`` is an error.
    """
    names = [f"Phi(~{a})p(~{b})" for a, b in models]
    spec = F.explode(F.array(*[F.lit(n) for n in names])).alias("model")
    stats = sufficient_stats(freq.withColumn("dataset", F.col(dataset).cast("string")), group, k, ["dataset"])
    x = stats.select("dataset", group, "occ", *STATS, spec)
    lv = [str(v) for v in levels]
    kinds = dict(zip(names, models))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ds, model = pdf["dataset"].iloc[0], pdf["model"].iloc[0]
        a, b = kinds[model]
        unknown = set(pdf[group].astype(str)) - set(lv)
        if unknown:
            raise ValueError(f"undeclared group levels: {sorted(unknown)}")
        present = [v for v in lv if v in set(pdf[group].astype(str))]
        labels, beta, cov, n2, kest, conv, it = fit_cov(
            pdf.assign(**{group: pdf[group].astype(str)}), group, present, k, a, b)
        se = np.sqrt(np.clip(np.diag(cov), 0, None))
        return pd.DataFrame({
            "dataset": ds, "model": model,
            "param": [lab.split(":")[0] for lab in labels],
            "beta_index": np.arange(1, len(labels) + 1, dtype="int32"),
            "label": labels, "estimate": beta, "se": se,
            "lcl": beta - Z95 * se, "ucl": beta + Z95 * se,
            "neg2lnl": n2, "k": np.int32(kest), "n_betas": np.int32(len(labels)),
            "converged": conv, "iterations": np.int32(it), "levels": "|".join(present),
            "at_bound": bool(np.abs(beta).max() > BOUND), "vcov": cov.tolist()})

    # the table is tiny, so AQE would coalesce it into one task and run the
    # fits one after another; an explicit partition count spreads the
    # (dataset, model) groups over the cluster (and satisfies the grouping
    # without another exchange)
    par = x.sparkSession.sparkContext.defaultParallelism
    x = x.repartition(par, "dataset", "model")
    return x.groupBy("dataset", "model").applyInPandas(run, FIT_SCHEMA)


def model_table(fits: DataFrame, ess: DataFrame) -> DataFrame:
    """AIC, AICc, BIC, delta AICc and Akaike weights per dataset.

    ``ess`` has (dataset, ess); n for AICc and BIC is the effective sample
    size, k the estimable parameter count.
    """
    from pyspark.sql import Window
    m = fits.groupBy("dataset", "model").agg(F.first("neg2lnl").alias("neg2lnl"),
                                             F.first("k").alias("k"))
    m = m.join(ess, "dataset")
    k, n = F.col("k"), F.col("ess")
    aic = F.col("neg2lnl") + 2 * k
    m = m.select("dataset", "model", "neg2lnl", "k", "ess", aic.alias("aic"),
                 (aic + F.try_divide(2 * k * (k + 1), (n - k - 1).cast("double"))).alias("aicc"),
                 (F.col("neg2lnl") + k * F.log(n)).alias("bic"))
    w = Window.partitionBy("dataset")
    m = m.withColumn("delta_aicc", F.col("aicc") - F.min("aicc").over(w))
    m = m.withColumn("__l", F.exp(-F.col("delta_aicc") / 2))
    return m.withColumn("weight", F.try_divide(F.col("__l"), F.sum("__l").over(w))).drop("__l")


def real_estimates(fits: DataFrame) -> DataFrame:
    """Betas mapped through the inverse logit with their interval ends."""
    il = lambda c: 1 / (1 + F.exp(-F.col(c)))
    return fits.select("dataset", "model", "param", "beta_index", "label", "estimate", "se",
                       il("estimate").alias("real"), il("lcl").alias("real_lcl"),
                       il("ucl").alias("real_ucl"))


PARAM_SCHEMA = "dataset string, model string, grp string, phi array<double>, p array<double>"


def fitted_params(fits: DataFrame, k: int, group: str = "grp") -> DataFrame:
    """Real parameter arrays per (dataset, model, group) from fitted betas.

    Works on the fit table (one row per beta, with the group levels the
    fit used); each (dataset, model) group holds a few dozen rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ds, model = pdf["dataset"].iloc[0], pdf["model"].iloc[0]
        a, b = model[len("Phi(~"):-1].split(")p(~")
        present = pdf["levels"].iloc[0].split("|")
        beta = pdf.sort_values("beta_index")["estimate"].to_numpy()
        lphi, rphi = design_rows(a, "Phi", present, k)
        _, rp = design_rows(b, "p", present, k)
        nphi = len(lphi)
        il = lambda x: float(1.0 / (1.0 + np.exp(-x)))
        out = []
        for g in present:
            phi = [il(np.dot(x, beta[:nphi])) for gg, _, x in rphi if gg == g]
            pv = [il(np.dot(x, beta[nphi:])) for gg, _, x in rp if gg == g]
            out.append((ds, model, g, phi, [None] + pv))
        return pd.DataFrame(out, columns=["dataset", "model", group, "phi", "p"])

    return fits.groupBy("dataset", "model").applyInPandas(run, PARAM_SCHEMA.replace("grp", group))
