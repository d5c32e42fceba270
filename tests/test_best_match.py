"""Best match of repeated ids: the last release at or before a sample."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import golden_pit as G
from smolt.functions.scalars import parse_ts, paste
from smolt.operators import joins as J

T0 = dt.datetime(2024, 5, 1)


def brute(samples, releases):
    out = []
    for k, t, n in samples:
        fit = [r for r in releases if k is not None and r[0] == k and r[1] is not None and t is not None and r[1] <= t]
        best = min(fit, key=lambda r: (-(r[1] - T0).total_seconds(), r[2] is None, r[2] or "", r[3])) if fit else (None,) * 4
        out.append((n, best[1], best[2], best[3]))
    return sorted(out)


@pytest.mark.parametrize("bucket", [60, 3600, 86400 * 30])
def test_against_all_pairs(spark, bucket):
    rng = np.random.default_rng(bucket)
    when = lambda hot: T0 + dt.timedelta(minutes=int(rng.integers(0, 600 if hot else 6000)))
    key = lambda: ["hot", "a", "b", "c", None][int(rng.choice(5, p=[.5, .2, .15, .1, .05]))]
    samples = [(k := key(), when(k == "hot") if rng.random() > 0.03 else None, i) for i in range(700)]
    releases = [(k := key(), when(k == "hot") if rng.random() > 0.03 else None, [None, "x", "y"][int(rng.integers(0, 3))], i) for i in range(300)]
    s = spark.createDataFrame(samples, "tag string, st timestamp, n int").repartition(3)
    r = spark.createDataFrame(releases, "tag string, rt timestamp, treatment string, i int").repartition(2)
    got = J.last_before(s, r, "tag", "st", "rt", ["treatment", "i"], bucket_seconds=bucket)
    assert sorted((x["n"], x["rt"], x["treatment"], x["i"]) for x in got.collect()) == brute(samples, releases)


def test_no_release_and_shared_names(spark):
    s = spark.createDataFrame([("a", T0, 1)], "tag string, st timestamp, n int")
    r = spark.createDataFrame([], "tag string, rt timestamp, treatment string")
    assert [(x["n"], x["rt"]) for x in J.last_before(s, r, "tag", "st", "rt", ["treatment"]).collect()] == [(1, None)]
    with pytest.raises(ValueError, match="both sides"):
        J.last_before(s, s, "tag", "st", "st")


def test_recorded_releases_of_three_ids(spark):
    """The recorded samples of fc73, fc29 and f9c0 carry another treatment than
    their release; an earlier and a later release of the same id are added."""
    rel = [(f"{d} {t}", i, tr) for d, t, i, tr in G.RELEASES] + [("2024-05-24 12:30", "fc29", "late"), ("2024-05-22 09:00", "fc73", "early"),
                                                                ("2024-05-24 9:55:00 AM", "f9c0", "zzz")]
    r = spark.createDataFrame(rel, "at string, tag_id string, treatment string").select("tag_id", "treatment", parse_ts("at").alias("release_ts"))
    s = spark.createDataFrame([(x[5], x[0], x[4], x[2]) for x in G.RECAPTURES], "tag_id string, date string, at string, recorded string")
    s = s.select("tag_id", "recorded", parse_ts(paste("date", "at")).alias("sample_ts"))
    got = J.last_before(s, r, "tag_id", "sample_ts", "release_ts", ["treatment"]).where(F.col("tag_id").isin("fc73", "fc29", "f9c0"))
    assert {x["tag_id"]: (x["recorded"], x["treatment"], x["release_ts"].strftime("%d %H:%M:%S")) for x in got.collect()} == {
        "fc73": ("archimedes1", "control", "23 11:40:00"), "fc29": ("archimedes3", "archimedes2", "24 09:45:20"),
        "f9c0": ("archimedes3", "archimedes2", "24 09:55:00")}
    dup = {x["tag_id"]: x["n"] for x in J.dup_key_report(r, "tag_id").collect()}
    assert dup == {"fc29": 2, "fc73": 2, "f9c0": 2}
