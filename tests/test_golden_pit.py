"""The PIT recapture pipeline reproduces the reference's recorded counts,
group means and Welch t (fixtures in golden_pit.py)."""

import pytest
from pyspark.sql import functions as F

import golden_pit as G
from smolt.functions.scalars import null_tokens, parse_ts, paste
from smolt.operators import stats as St
from smolt.plans import pipelines as P


def _tables(spark):
    rec = spark.createDataFrame(G.RECAPTURES, "date string, site string, treatment string, "
                                "release_time string, sample_time string, tag_id string, "
                                "hemoglobin string, scale_loss int")
    rec = rec.select("site", "treatment", "tag_id", "scale_loss",
                     parse_ts(paste("date", "sample_time")).alias("sample_ts"),
                     null_tokens("hemoglobin").try_cast("double").alias("hemoglobin"))
    rel = spark.createDataFrame(G.RELEASES, "release_date string, release_time string, "
                                "tag_id string, release_treatment string")
    rel = rel.select("tag_id", "release_treatment",
                     parse_ts(paste("release_date", "release_time")).alias("release_ts"))
    return rel, rec.filter(F.col("site") != "hatchery")


def test_pit_recapture_counts(spark):
    rel, rec = _tables(spark)
    assert rel.filter(F.col("release_ts").isNull()).count() == 0
    assert rec.join(rel, "tag_id").count() == G.MATCHED
    kw = dict(key="tag_id", release_ts="release_ts", sample_ts="sample_ts", treatment="treatment",
              max_elapsed=60.0, units="mins", control=["control"], treated_label="archimedes")
    assert P.pit_recapture(rel, rec, **kw).count() == G.WITHIN_60
    final = P.pit_recapture(rel, rec, exclude=["archimedes1"], **kw)
    got = {r["release_group"]: r["count"] for r in final.groupBy("release_group").count().collect()}
    assert sum(got.values()) == G.FINAL and got == G.FINAL_BY_GROUP
    # the tag sampled exactly 60 minutes after release is out (strict <)
    assert final.filter(F.col("tag_id") == "fa1c").count() == 0


def test_hemoglobin_welch_and_scale_loss(spark):
    rel, rec = _tables(spark)
    final = P.pit_recapture(rel, rec, "tag_id", "release_ts", "sample_ts", "treatment", 60.0, "mins",
                            exclude=["archimedes1"], control=["control"], treated_label="archimedes")
    r = St.welch_t_test(final, "hemoglobin", "release_group", "archimedes", "control",
                        with_p=True).collect()[0]
    assert (r["n_a"], r["n_b"]) == (G.HEMOGLOBIN["archimedes"][0], G.HEMOGLOBIN["control"][0])
    assert r["mean_a"] == pytest.approx(G.HEMOGLOBIN["archimedes"][1], abs=1e-6)
    assert r["mean_b"] == pytest.approx(G.HEMOGLOBIN["control"][1], abs=1e-6)
    assert r["t"] == pytest.approx(G.WELCH_T, abs=5e-5)
    assert r["df"] == pytest.approx(G.WELCH_DF, abs=5e-4)
    assert 0 < r["p_value"] < 0.05
    sl = {(x["pump"], x["value"]): x["n"] for x in
          P.scale_loss_classes(final, "treatment", "scale_loss", control=["control"]).collect()}
    assert sl == G.SCALE_LOSS


def test_dup_key_report(spark):
    from smolt.operators.joins import dup_key_report
    rel = spark.createDataFrame(G.RELEASES + [("2024-05-24", "12:08", "f9c3", "archimedes3")],
                                "d string, t string, tag_id string, treatment string")
    got = [(r["tag_id"], r["n"]) for r in dup_key_report(rel, "tag_id").collect()]
    assert got == [("f9c3", 2)]
