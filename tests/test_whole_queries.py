"""Queries over fits and whole tables, against fits on the driver and plain counting."""

import numpy as np
import pytest

import __spark_entry__ as E
from conftest import SF001
from smolt.operators import survival as S
from smolt.plans import q_aggs
from smolt.plans import q_survival as Q
from smolt.sources import tables as T


def run(spark, key):
    return [r.asDict() for r in E.queries()[key](spark, SF001).collect()]


@pytest.fixture(scope="module")
def fitted(spark):
    """Fits of each region alone, on the driver: (labels, beta, se, neg2lnl, k, ...)."""
    freq = Q.dataset_frequencies(spark, SF001).toPandas()
    out = {}
    for ds, pdf in freq.groupby("dataset"):
        levels = [g for g in Q.SEGMENTS if g in set(pdf["grp"])]
        for a, b in Q.MODELS:
            out[ds, f"Phi(~{a})p(~{b})"] = S.fit_cjs(S.stats_of(pdf, "grp", Q.K), "grp", levels, Q.K, a, b)
    return out


def test_real_estimates_are_fitted_per_region(spark, fitted):
    rows = run(spark, "real_estimates")
    assert {r["dataset"] for r in rows} == {ds for ds, _ in fitted}
    for r in rows:
        labels, beta, se = fitted[r["dataset"], "Phi(~group)p(~dot)"][:3]
        i = labels.index(r["label"])
        assert r["estimate"] == pytest.approx(beta[i], abs=1e-4) and r["se"] == pytest.approx(se[i], rel=1e-2, abs=1e-3)
    first = {r["dataset"]: r["estimate"] for r in rows if r["beta_index"] == 1}
    assert len(set(first.values())) == len(first)


def test_model_rank_ranks_the_fitted_grid(spark, fitted):
    rows = run(spark, "model_rank")
    assert {(r["dataset"], r["model"]) for r in rows} == set(fitted) and len(rows) == len(fitted)
    for r in rows:
        n2, k = fitted[r["dataset"], r["model"]][3:5]
        assert r["neg2lnl"] == pytest.approx(n2, abs=1e-3) and r["k"] == k
        assert r["aicc"] == pytest.approx(n2 + 2 * k + 2 * k * (k + 1) / (r["ess"] - k - 1), abs=1e-3)
    for ds in {r["dataset"] for r in rows}:
        own = [r for r in rows if r["dataset"] == ds]
        assert min(r["delta_aicc"] for r in own) == 0 and sum(r["weight"] for r in own) == pytest.approx(1)


def test_pivot_counts_the_tags_of_all_detections(spark):
    group = {r["tag"]: r["release_group"] for r in T.tags(spark, SF001).collect()}
    cells = {}
    for r in T.detections(spark, SF001).select("site", "tag").collect():
        if r["tag"] in group:
            cells.setdefault(r["site"], {}).setdefault(group[r["tag"]], set()).add(r["tag"])
    got = {r.pop("site"): r for r in run(spark, "pivot_count_distinct")}
    assert got == {site: {s: len(c[s]) if s in c else None for s in q_aggs.SEGMENTS} for site, c in cells.items()}


def test_pivot_cell_without_a_tag_is_null(spark):
    seen = [("a", "x", "BUILDING"), ("a", "x", "BUILDING"), ("a", "y", "BUILDING"), ("b", "x", "MACHINERY")]
    got = {r["site"]: r.asDict() for r in q_aggs._distinct_tags(
        spark.createDataFrame(seen, "site string, tag string, release_group string")).collect()}
    assert got["a"]["BUILDING"] == 2 and got["a"]["MACHINERY"] is None
    assert got["b"]["MACHINERY"] == 1 and got["b"]["BUILDING"] is None


def test_goodness_of_fit_is_that_of_the_fitted_model(spark, fitted):
    freq = Q.dataset_frequencies(spark, SF001).toPandas()
    rows = run(spark, "gof_stats")
    assert {r["dataset"] for r in rows} == {ds for ds, _ in fitted} and len(rows) == len(set(r["dataset"] for r in rows))
    for r in rows:
        n2, k = fitted[r["dataset"], "Phi(~dot)p(~dot)"][3:5]
        own = freq[freq["dataset"] == r["dataset"]]
        cohorts = len(set(zip(own["grp"], own["ch"].str.index("1"))))
        assert r["neg2lnl"] == pytest.approx(n2, abs=1e-3)
        assert r["deviance_df"] == len(own) - cohorts - k
        assert r["c_hat"] == pytest.approx(r["deviance"] / r["deviance_df"])


def test_scores_vanish_at_the_fitted_betas(spark, fitted):
    """Interior fits: the score is zero and the information positive."""
    rows = run(spark, "cjs_fit_score")
    assert {(r["dataset"], r["model"]) for r in rows} == set(fitted)
    inside = 0
    for (ds, model), (labels, beta, se, n2, k, *_) in fitted.items():
        own = sorted((r["beta_index"], r["score"], r["information"]) for r in rows if (r["dataset"], r["model"]) == (ds, model))
        assert len(own) == len(labels)
        assert all(abs(s) < 1e-2 for _, s, _ in own)
        if max(abs(beta)) < S.BOUND and k == len(labels):
            info = np.array([h for *_, h in own])
            assert np.linalg.eigvalsh((info + info.T) / 2).min() > 0
            assert np.sqrt(np.diag(np.linalg.inv(info))) == pytest.approx(se, rel=1e-2)
            inside += 1
    assert inside


def test_real_parameters_map_the_fits(spark, fitted):
    rows = run(spark, "real_parameters_fitted")
    assert {(r["dataset"], r["model"]) for r in rows} == set(fitted)
    for r in rows:
        if r["model"] == "Phi(~dot)p(~dot)":
            beta, se = (x[0 if r["param"] == "Phi" else 1] for x in fitted[r["dataset"], r["model"]][1:3])
            real = 1 / (1 + np.exp(-beta))
            assert r["estimate"] == pytest.approx(real, abs=1e-5) and r["se"] == pytest.approx(real * (1 - real) * se, rel=1e-2)
