"""Cleaning semantics on a hand-built detection fixture (FIXTURES F8):
detection before release, gaps of exactly 45 s and 44 s, two receivers at
one instant, a tag never seen after release, a tag outside the study, a
tag with a single kept detection, and an upstream hit after a downstream
one."""

import datetime as dt

from pyspark.sql import functions as F

from smolt.plans import pipelines as P

T0 = dt.datetime(2024, 5, 10, 12, 0, 0)


def at(s):
    return T0 + dt.timedelta(seconds=s)


DETS = [  # tag, site, seconds after T0, tie
    (1, "up", -10, 1), (1, "up", 100, 2), (1, "up", 145, 3), (1, "up", 189, 4),
    (1, "down", 300, 5), (1, "up", 300, 6), (1, "up", 500, 7),
    (2, "up", 900, 8),
    (3, "up", 100, 9), (3, "down", 200, 10),
    (4, "mission", 50, 11), (4, "mission", 200, 12),
]
RELEASES = [(1, 0), (2, 1000), (3, 0), (4, 0)]


def _frames(spark):
    det = spark.createDataFrame([(t, s, at(x), i) for t, s, x, i in DETS],
                                "tag long, site string, ts timestamp, tie long")
    rel = spark.createDataFrame([(t, at(x)) for t, x in RELEASES], "tag long, release_ts timestamp")
    sites = spark.createDataFrame([("up", 110.2), ("down", 110.1), ("mission", 67.0)],
                                  "site string, rkm double")
    fish = spark.createDataFrame([(1, "ham.us"), (2, "ham.us"), (3, "ham.ds"), (4, "ham.ds")],
                                 "tag long, release_group string")
    study = spark.createDataFrame([(1,), (2,), (4,)], "tag long")
    return det, rel, sites, fish, study


def _clean(spark):
    det, rel, sites, fish, study = _frames(spark)
    return P.detection_clean(det, study, rel, sites, fish)


def test_detection_clean_fixture(spark):
    got = sorted((r["tag"], r["ts"], r["site"], r["diff_time"]) for r in _clean(spark).collect())
    assert got == [(1, at(145), "up", None), (1, at(300), "down", 155.0),
                   (1, at(500), "up", 200.0), (4, at(200), "mission", None)]


def test_upstream_artifact_fixture(spark):
    c = _clean(spark).select("tag", "site", "ts", "tie")
    out = P.upstream_artifact_filter(c, ["up"], ["down"], ["up"])
    got = sorted((r["tag"], r["ts"], r["move_dir"]) for r in out.collect())
    assert got == [(1, at(145), "DOWN"), (1, at(300), "DOWN"), (4, at(200), "DOWN")]
