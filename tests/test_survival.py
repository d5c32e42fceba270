"""CJS likelihood, fit and goodness of fit against the recorded listing."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from golden import M018_DOT, M018_GROUP, M018_GROUPS, m018_long
from smolt.operators import histories as Hst
from smolt.operators import survival as S

K = 8


@pytest.fixture(scope="module")
def freq(spark):
    return spark.createDataFrame(m018_long(), "ch string, grp string, n long") \
        .withColumn("dataset", F.lit("all"))


def test_fit_dot_matches_listing():
    pdf = pd.DataFrame(m018_long(), columns=["ch", "grp", "n"])
    labels, beta, se, n2, kest, conv, _ = S.fit_cjs(S.stats_of(pdf, "grp", K), "grp", list(M018_GROUPS), K, "dot", "dot")
    assert conv and kest == 2
    assert beta == pytest.approx(M018_DOT["beta"], abs=1e-5)
    assert se == pytest.approx(M018_DOT["se"], abs=1e-5)
    assert n2 == pytest.approx(M018_DOT["neg2lnl"], abs=1e-3)


def test_fit_group_matches_listing():
    pdf = pd.DataFrame(m018_long(), columns=["ch", "grp", "n"])
    labels, beta, se, n2, kest, conv, _ = S.fit_cjs(S.stats_of(pdf, "grp", K), "grp", list(M018_GROUPS), K, "group", "dot")
    assert beta == pytest.approx(M018_GROUP["beta"], abs=1e-4)
    assert n2 == pytest.approx(M018_GROUP["neg2lnl"], abs=1e-3)


def test_ess_saturated(freq):
    ess = Hst.effective_sample_size(freq, K, ["dataset"]).collect()[0]["ess"]
    sat = Hst.saturated_neg2lnl(freq, "grp", K, ["dataset"]).collect()[0]["neg2lnl_sat"]
    assert ess == M018_DOT["ess"]
    assert sat == pytest.approx(M018_DOT["neg2lnl_sat"], abs=1e-4)


def test_loglik_and_gof(spark, freq):
    b = M018_DOT["beta"]
    il = lambda x: 1 / (1 + __import__("math").exp(-x))
    params = S.constant_params(freq, "grp", K, il(b[0]), il(b[1]), ["dataset"])
    ll = S.cjs_loglik(freq, params, "grp", K, ["dataset"]).agg(F.sum("loglik")).collect()[0][0]
    assert -2 * ll == pytest.approx(M018_DOT["neg2lnl"], abs=1e-3)
    kp = spark.createDataFrame([("all", 2)], "dataset string, k int")
    g = S.gof_stats(freq, params, "grp", K, kp, ["dataset"]).collect()[0]
    for key in ("deviance", "pearson_chisq", "s_bar", "fletcher_chat"):
        assert g[key] == pytest.approx(M018_DOT[key], rel=1e-5), key
    assert g["possible"] == M018_DOT["possible"]
    assert g["deviance_df"] == M018_DOT["deviance_df"]
    assert g["pearson_df"] == M018_DOT["pearson_df"]


def test_fit_models_parallel_and_rank(spark, freq):
    fits = S.fit_models(freq, "grp", list(M018_GROUPS), K, [("dot", "dot"), ("group", "dot")])
    ess = Hst.effective_sample_size(freq, K, ["dataset"])
    tbl = S.model_table(fits, ess).collect()
    dot = [r for r in tbl if r["model"] == "Phi(~dot)p(~dot)"][0]
    assert dot["aicc"] == pytest.approx(M018_DOT["aicc"], abs=1e-3)
    assert abs(sum(r["weight"] for r in tbl) - 1) < 1e-9


def test_m_array_consistent(freq):
    m = Hst.m_array(freq, "grp", K).collect()
    # every animal is released at its first capture (if before K)
    tot_first = sum(n for ch, g, n in m018_long())
    first_rel = sum(r["n"] for r in m if r["release_occ"] == 1)
    assert first_rel == tot_first
    for r in m:
        assert r["recapture_occ"] is None or r["recapture_occ"] > r["release_occ"]


def test_closed_form_m003(spark):
    from golden import M003_LAST_PRODUCT, M003_P, M003_PHI, m001_long
    f = spark.createDataFrame(m001_long(), "ch string, grp string, n long")
    t = {r["occ"]: r for r in Hst.closed_form_time(f, 7).collect()}
    for j, v in M003_PHI.items():
        assert t[j]["phi"] == pytest.approx(v, abs=5e-5)
    for j, v in M003_P.items():
        assert t[j]["p"] == pytest.approx(v, abs=5e-5)
    assert t[6]["last_product"] == pytest.approx(M003_LAST_PRODUCT, abs=5e-5)


def test_time_model_boundary_neg2lnl():
    from golden import M003_NEG2LNL, m001_long
    pdf = pd.DataFrame(m001_long(), columns=["ch", "grp", "n"])
    *_, n2, kest, conv, _ = S.fit_cjs(S.stats_of(pdf, "grp", 7), "grp", ["g1", "g2"], 7, "time", "time")
    assert n2 == pytest.approx(M003_NEG2LNL, abs=1e-2)
    assert kest == 9 and _aicc(n2, kest, 555) == pytest.approx(759.14460, abs=1e-2)


def _aicc(n2, k, n):
    return n2 + 2 * k + 2 * k * (k + 1) / (n - k - 1)


@pytest.mark.parametrize("phi,p,k,n2,aicc", [  # fixed values: recorded fits M002, M014, M015
    ("group", "time", 7, 871.28235, 885.48711), ("group", "group", 4, 1051.4385, 1059.5113), ("group", "dot", 3, 1053.2493, 1059.2929)])
def test_recorded_fits(phi, p, k, n2, aicc):
    from golden import m001_long
    pdf = pd.DataFrame(m001_long(), columns=["ch", "grp", "n"])
    *_, got, kest, conv, _ = S.fit_cjs(S.stats_of(pdf, "grp", 7), "grp", ["g1", "g2"], 7, phi, p)
    assert conv and kest == k and got == pytest.approx(n2, abs=1e-3) and _aicc(got, kest, 555) == pytest.approx(aicc, abs=1e-3)


def test_boundary_fits_are_flagged(spark):
    from golden import m001_long
    f = spark.createDataFrame(m001_long(), "ch string, grp string, n long").withColumn("dataset", F.lit("a"))
    fits = S.fit_models(f, "grp", ["g1", "g2"], 7, [("time", "time"), ("dot", "dot")]).select("model", "k", "at_bound").distinct().collect()
    assert {(r["model"], r["k"], r["at_bound"]) for r in fits} == {("Phi(~time)p(~time)", 9, True), ("Phi(~dot)p(~dot)", 2, False)}


@pytest.mark.parametrize("k", [56, 60, 80])
def test_many_occasions(spark, k):
    """No limit on the number of occasions, from sightings to a fit."""
    rng = np.random.default_rng(k)
    rows, want = [], {}
    for tag in range(60):
        seen = sorted(set((rng.integers(0, k) * rng.random(8)).astype(int).tolist()))
        rows += [(tag, "g", o) for o in seen]
        want[tag] = "".join("1" if j in seen else "0" for j in range(k))
    s = spark.createDataFrame(rows + [(999, "g", None)], "tag long, grp string, occ int")
    h = Hst.encounter_history(s, "tag", "grp", "occ", k)
    assert {r["tag"]: r["ch"] for r in h.collect()} == want
    f = Hst.history_frequency(h, "grp").withColumn("dataset", F.lit("a"))
    fits = S.fit_models(f, "grp", ["g"], k, [("dot", "dot")]).collect()
    assert fits[0]["converged"] and fits[0]["k"] == 2
    params = S.constant_params(f, "grp", k, 0.9, 0.2, ["dataset"])
    g = S.gof_stats(f, params, "grp", k, spark.createDataFrame([("a", 2)], "dataset string, k int"), ["dataset"]).collect()[0]
    assert g["possible"] == pytest.approx(sum(2.0 ** (k - 1 - f) for f in {w.index("1") for w in want.values()}))


def test_unknown_occasions_and_groups_are_errors(spark):
    s = spark.createDataFrame([(1, "g", 0), (1, "g", 7)], "tag long, grp string, occ int")
    with pytest.raises(Exception, match="occasion outside"):
        Hst.encounter_history(s, "tag", "grp", "occ", 7).collect()
    f = spark.createDataFrame([("a", "101", "x", 3)], "dataset string, ch string, grp string, n long")
    with pytest.raises(Exception, match="undeclared group"):
        S.fit_models(f, "grp", ["g"], 3, [("dot", "dot")]).collect()


def test_m001_gof_dot(spark):
    from golden import M001_DOT, m001_long
    pdf = pd.DataFrame(m001_long(), columns=["ch", "grp", "n"])
    labels, beta, se, n2, kest, conv, _ = S.fit_cjs(S.stats_of(pdf, "grp", 7), "grp", ["g1", "g2"], 7, "dot", "dot")
    assert n2 == pytest.approx(M001_DOT["neg2lnl"], abs=1e-3)
    f = spark.createDataFrame(m001_long(), "ch string, grp string, n long").withColumn("dataset", F.lit("a"))
    il = lambda x: 1 / (1 + __import__("math").exp(-x))
    params = S.constant_params(f, "grp", 7, il(beta[0]), il(beta[1]), ["dataset"])
    kp = spark.createDataFrame([("a", 2)], "dataset string, k int")
    g = S.gof_stats(f, params, "grp", 7, kp, ["dataset"]).collect()[0]
    assert g["deviance"] == pytest.approx(M001_DOT["deviance"], abs=1e-3)
    assert g["deviance_df"] == M001_DOT["deviance_df"]
    assert g["possible"] == M001_DOT["possible"]
    assert g["s_bar"] == pytest.approx(M001_DOT["s_bar"], abs=1e-6)


def test_fit_to_gof_chain(spark, freq):
    fits = S.fit_models(freq, "grp", list(M018_GROUPS), K, [("dot", "dot")])
    params = S.fitted_params(fits, K).drop("model")
    kk = fits.groupBy("dataset").agg(F.first("k").alias("k"))
    g = S.gof_stats(freq, params, "grp", K, kk, ["dataset"]).collect()[0]
    assert g["deviance"] == pytest.approx(M018_DOT["deviance"], abs=1e-3)
    assert g["fletcher_chat"] == pytest.approx(M018_DOT["fletcher_chat"], abs=1e-5)
