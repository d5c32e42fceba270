"""Parameter index, design coding, real parameters and score against the
recorded listings."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from golden import M018_GROUPS, m001_long, m018_long
from smolt.operators import designs as D
from smolt.operators import scores as C
from smolt.operators import survival as S

# 8 occasions, two release groups (history, count in 0, count in 1).
M021_FREQ = [
    ("01000000", 0, 5), ("01000000", 60, 0), ("01000010", 6, 0), ("01001000", 0, 1), ("01001010", 1, 0), ("01010000", 2, 0),
    ("01011001", 1, 0), ("01011010", 1, 0), ("01100000", 0, 1), ("01100000", 6, 0), ("01100010", 2, 0), ("01100110", 1, 0),
    ("01101010", 1, 0), ("01101011", 2, 0), ("01110000", 3, 0), ("01110010", 2, 0), ("01110111", 1, 0), ("01111010", 1, 0),
    ("01111011", 1, 0), ("10000000", 0, 6), ("11000000", 0, 61), ("11000000", 6, 0), ("11000001", 0, 1), ("11000010", 0, 3),
    ("11000010", 1, 0), ("11001010", 0, 1), ("11001011", 0, 1), ("11010000", 0, 1), ("11100000", 0, 4), ("11100001", 0, 2),
    ("11100010", 0, 1), ("11100010", 1, 0), ("11101000", 0, 2), ("11101000", 1, 0), ("11101010", 0, 4), ("11101011", 0, 2),
    ("11110000", 0, 2), ("11110010", 0, 1), ("11111000", 0, 3), ("11111001", 0, 1),
]
# Real parameters as listed (param, group, occasion): estimate, se, lower, upper.
M021_REAL = {("Phi", "g1", 1): (0.6929611, 0.0315705, 0.6278891, 0.7511635), ("Phi", "g2", 1): (0.7529070, 0.0254243, 0.6997945, 0.7993176),
             ("p", "g1", 2): (0.5095211, 0.0304937, 0.4499016, 0.5688710)}
M018_REAL = {("Phi", "ham.ds", 1): (0.7373369, 0.0174945, 0.7016408, 0.7701611), ("p", "ham.ds", 2): (0.6895947, 0.0253012, 0.6379675, 0.7368960)}
M029_REAL = {("Phi", "ham.ds", 1): (0.7391794, 0.0242439, 0.6889546, 0.7838389), ("Phi", "ham.us", 1): (0.7354316, 0.0247564, 0.6841644, 0.7810403),
             ("p", "ham.ds", 2): (0.6895652, 0.0253040, 0.6379325, 0.7368719)}
M002_REAL = {("Phi", "g1", 1): (0.7985211, 0.0374972, 0.7150958, 0.8622245), ("Phi", "g2", 1): (0.8102811, 0.0370104, 0.7270993, 0.8725528),
             ("p", "g1", 3): (0.3812353, 0.0512719, 0.2869352, 0.4854289), ("p", "g1", 4): (0.4219546, 0.0739587, 0.2871899, 0.5694388),
             ("p", "g1", 5): (0.2928752, 0.0713448, 0.1741247, 0.4486198), ("p", "g1", 6): (0.4168250, 0.1099308, 0.2275483, 0.6342668),
             ("p", "g1", 7): (0.2495174, 0.0888393, 0.1159810, 0.4572736)}
# Betas of the cell-means models as listed (the first p is at its bound).
M002_BETA = {"Phi:(Intercept)": (1.3770767, 0.2330681), "Phi:groupg2": (0.0747612, 0.2307744), "p:time3": (-0.4843084, 0.2173507),
             "p:time4": (-0.3147548, 0.3032227), "p:time5": (-0.8814605, 0.3444957), "p:time6": (-0.3358207, 0.4522378), "p:time7": (-1.1011879, 0.4744207)}
M005_BETA = {**M002_BETA, "Phi:groupg1": (1.3770762, 0.2330678), "Phi:groupg2": (1.4518371, 0.2407561)}
del M005_BETA["Phi:(Intercept)"]


def m021_long():
    return [(ch, g, n) for ch, a, b in M021_FREQ for g, n in (("g1", a), ("g2", b)) if n]


def table(spark, rows):
    return spark.createDataFrame(rows, "ch string, grp string, n long").withColumn("dataset", F.lit("a"))


@pytest.mark.parametrize("rows,k,model,real", [
    (m021_long(), 8, ("group", "dot"), M021_REAL), (m018_long(), 8, ("dot", "dot"), M018_REAL), (m018_long(), 8, ("group", "dot"), M029_REAL),
    (m001_long(), 7, ("group", "-1+time"), M002_REAL)])
def test_real_parameters_of_the_listings(spark, rows, k, model, real):
    f = table(spark, rows)
    groups = sorted({g for _, g, _ in rows})
    fits = S.fit_models(f, "grp", groups, k, [model])
    got = {(r["param"], r["grp"], r["occasion"]): r for r in
           D.real_parameters(fits, D.design_table(f, "grp", k, [model], ["dataset"])).collect()}
    assert len(got) == 2 * len(groups) * (k - 1)
    for key, want in real.items():
        assert [got[key][c] for c in ("estimate", "se", "lcl", "ucl")] == pytest.approx(want, abs=2e-6), key


@pytest.mark.parametrize("model,betas", [(("group", "-1+time"), M002_BETA), (("-1+group", "-1+time"), M005_BETA)])
def test_cell_means_fits(spark, model, betas):
    fits = {r["label"]: r for r in S.fit_models(table(spark, m001_long()), "grp", ["g1", "g2"], 7, [model]).collect()}
    one = fits["p:time2"]
    assert set(betas) | {"p:time2"} == set(fits) and one["k"] == 7 and one["at_bound"]
    assert one["neg2lnl"] + 2 * 7 + 2 * 7 * 8 / (555 - 8) == pytest.approx(885.48711, abs=1e-3)
    for label, (beta, se) in betas.items():
        assert fits[label]["estimate"] == pytest.approx(beta, abs=5e-5) and fits[label]["se"] == pytest.approx(se, abs=5e-5)


def test_index_matrices(spark):
    """The triangular matrices of the saved runs: Phi(~1)p(~1),
    Phi(~1 + release)p(~-1 + time) and Phi(~release)p(~release)."""
    models = [("dot", "dot"), ("group", "-1+time"), ("group", "group")]
    rows = D.parameter_index(table(spark, m001_long()), "grp", 7, models, ["dataset"]).collect()
    simple = {D.model_name(*models[0]): lambda p, g, t: 1 if p == "Phi" else 2,
              D.model_name(*models[1]): lambda p, g, t: g + 1 if p == "Phi" else t + 1,
              D.model_name(*models[2]): lambda p, g, t: g + 1 + (0 if p == "Phi" else 2)}
    cells = [(p, g, c, t) for p in ("Phi", "p") for g in range(2) for c in range(1, 7)
             for t in (range(c, 7) if p == "Phi" else range(c + 1, 8))]
    want = {(m, p, f"g{g + 1}", c, t): (n + 1, rule(p, g, t)) for m, rule in simple.items() for n, (p, g, c, t) in enumerate(cells)}
    assert {(r["model"], r["param"], r["grp"], r["cohort"], r["occasion"]): (r["different"], r["simple"]) for r in rows} == want


def test_design_table_is_that_of_the_fits(spark):
    models = [("dot", "time"), ("-1+group", "-1+time"), ("group", "group"), ("time", "-1+group")]
    f = table(spark, m001_long())
    got = {(r["model"], r["param"], r["grp"], r["occasion"]): (list(r["x"]), r["labels"]) for r in D.design_table(f, "grp", 7, models, ["dataset"]).collect()}
    for phi, p in models:
        (lf, rf), (lp, rp) = S.design_rows(phi, "Phi", ["g1", "g2"], 7), S.design_rows(p, "p", ["g1", "g2"], 7)
        name = D.model_name(phi, p)
        for g, t, x in rf:
            assert got.pop((name, "Phi", g, t)) == (x + [0.0] * len(lp), lf + lp)
        for g, t, x in rp:
            assert got.pop((name, "p", g, t)) == ([0.0] * len(lf) + x, lf + lp)
    assert not got
    with pytest.raises(ValueError, match="unknown formula"):
        D.design_table(f, "grp", 7, [("age", "dot")], ["dataset"])


def test_score_is_the_gradient_and_vanishes_at_fits(spark):
    f, groups = table(spark, m018_long()), list(M018_GROUPS)
    models = [("dot", "dot"), ("group", "dot"), ("-1+group", "group")]
    fits = S.fit_models(f, "grp", groups, 8, models)
    design = D.design_table(f, "grp", 8, models, ["dataset"])
    at = C.fitted_score(f, fits, design, "grp", 8).collect()
    assert len(at) == 2 + 3 + 4 and all(abs(r["score"]) < 1e-4 for r in at)
    pdf = pd.DataFrame(m018_long(), columns=["ch", "grp", "n"])
    stats = S.stats_of(pdf, "grp", 8)
    for phi, p in models:
        own = sorted((r["beta_index"], r["information"]) for r in at if r["model"] == D.model_name(phi, p))
        info = np.array([h for _, h in own])
        cov = S.fit_cov(stats, "grp", groups, 8, phi, p)[2]
        assert np.linalg.eigvalsh((info + info.T) / 2).min() > 0
        assert np.linalg.inv(info) == pytest.approx(cov, abs=1e-5)
    # away from the fit: against differences of the log-likelihood
    d = S._Data(stats, "grp", groups, 8)
    xf, xp = (np.array([x for _, _, x in S.design_rows(kind, q, groups, 8)[1]]) for kind, q in (("-1+group", "Phi"), ("group", "p")))
    beta = np.array([0.3, -0.4, 0.2, 0.5])
    want = [-(S._neg_loglik(beta + e, d, xf, xp, 2) - S._neg_loglik(beta - e, d, xf, xp, 2)) / 2e-5 for e in np.eye(4) * 1e-5]
    moved = spark.createDataFrame([("a", D.model_name("-1+group", "group"), beta.tolist())], "dataset string, model string, beta array<double>")
    got = C.beta_scores(C.stat_arrays(f, "grp", 8, ["dataset"]), design, moved, "grp", 8, ["dataset", "model"]).orderBy("i").collect()
    assert [r["score"] for r in got] == pytest.approx(want, rel=1e-5)
