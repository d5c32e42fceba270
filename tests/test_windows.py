"""Sequence operators equal one window per group."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from pyspark.sql import Window
from smolt import session
from smolt.operators import windows as W


def plain_shift(d, by, lags=None, leads=None):
    """One window per group: the definition."""
    w = Window.partitionBy(*by).orderBy(F.col("ts").asc_nulls_last(), F.col("tie").asc_nulls_last())
    return d.withColumns({**{o: F.lag(c).over(w) for o, c in (lags or {}).items()},
                          **{o: F.lead(c).over(w) for o, c in (leads or {}).items()}})


def plain_row_number(d, by):
    w = Window.partitionBy(*by).orderBy(F.col("ts").asc_nulls_last(), F.col("tie").asc_nulls_last())
    return d.withColumn("rn", F.row_number().over(w))


def _det(spark):
    return (spark.read.parquet(f"{SF001}/events.parquet")
            .select(F.col("user_id").alias("tag"), F.col("event_type").alias("site"),
                    "ts", F.col("event_id").alias("tie"), "value"))


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(params=[1, 7, 40])
def tasks(spark, request):
    """Range partitions: results never depend on their number."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


@pytest.fixture(params=[1, 3, 10_000])
def batch(spark, request):
    """Rows of an Arrow batch: neighbours lie in different ones."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield request.param
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_shift_matches_plain(spark, tasks):
    d = _det(spark)
    kw = dict(lags={"prev_ts": "ts", "prev_site": "site"}, leads={"next_ts": "ts"})
    a = plain_shift(d, ["tag"], **kw)
    b = W.sequence_shift(d, ["tag"], "ts", "tie", **kw)
    cols = ["tie", "prev_ts", "prev_site", "next_ts"]
    assert _rows(a, cols) == _rows(b, cols)


def test_row_number_matches_plain(spark, tasks):
    d = _det(spark)
    a = plain_row_number(d, ["tag", "site"])
    b = W.sequence_row_number(d, ["tag", "site"], "ts", "tie")
    assert _rows(a, ["tie", "rn"]) == _rows(b, ["tie", "rn"])


def test_null_group_and_time(spark):
    t = dt.datetime(2024, 5, 1)
    rows = [(None, t, 1), (None, t + dt.timedelta(days=2), 2), (None, None, 3),
            (1, t, 4), (1, t, 5)]
    d = spark.createDataFrame(rows, "tag long, ts timestamp, tie long")
    b = W.sequence_shift(d, ["tag"], "ts", "tie", lags={"p": "tie"})
    got = {r["tie"]: r["p"] for r in b.collect()}
    # NULL tag forms one group; NULL time sorts last; ties broken by tie
    assert got == {1: None, 2: 1, 3: 2, 4: None, 5: 4}


def test_first_and_nth(spark, tasks):
    d = _det(spark)
    first = W.first_per_group(d, ["tag", "site"], "ts", "tie")
    plain = plain_row_number(d, ["tag", "site"])
    assert _rows(first, ["tie"]) == _rows(plain.filter("rn = 1"), ["tie"])
    second = W.nth_per_group(d, ["tag", "site"], "ts", "tie", 2)
    assert _rows(second, ["tie"]) == _rows(plain.filter("rn = 2"), ["tie"])


def test_chained_pipeline_same_at_every_width(spark):
    from smolt.operators import movement as M
    det = _det(spark).select("tag", "site", "ts", "tie")
    out, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, 30):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seg = M.segment_durations(M.gap_filter(det, 45.0), ["signup"])
        out.append(sorted((r["location_site"], r["prev_location"], r["n"], round(r["mean"] or -1, 9))
                          for r in seg.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1] and len(out[0]) > 0


@pytest.mark.parametrize("gap_micros", [3600, 10 ** 9])
def test_hot_tag_is_cut_anywhere(spark, tasks, gap_micros):
    """One tag with all rows, dense or one row every 17 minutes over years:
    every range task holds its share."""
    n = 200_000
    d = spark.range(n).select(F.lit(1).cast("long").alias("tag"), F.col("id").alias("tie"),
                              F.timestamp_micros(F.lit(10 ** 15) + F.col("id") * gap_micros).alias("ts"))
    out = W.sequence_shift(d, ["tag"], "ts", "tie", lags={"p": "tie"}, leads={"q": "tie"})
    got = out.agg(F.count("p"), F.count("q"), F.max(F.abs(F.col("tie") - F.col("p") - 1)), F.max(F.abs(F.col("q") - F.col("tie") - 1))).first()
    assert tuple(got) == (n - 1, n - 1, 0, 0)
    rn = W.sequence_row_number(d, ["tag"], "ts", "tie")
    assert rn.filter(F.col("rn") != F.col("tie") + 1).count() == 0 and rn.count() == n
    written = spark.read.parquet(scratch("sequence-numbers")[-1])
    sizes = [r["count"] for r in written.groupBy("__pid").count().collect()]
    assert len(sizes) == tasks and max(sizes) <= 2 * n / tasks


def scratch(name):
    return [p for p in session._scratch if os.path.basename(p).startswith(name)]


def test_one_exchange_of_the_rows(spark):
    """What is read back is not moved again; only the edges meet, two a task."""
    d = _det(spark)
    plan = W.sequence_shift(d, ["tag"], "ts", "tie", lags={"p": "tie"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange SinglePartition" in plan
    copy = spark.read.parquet(scratch("sequence-")[-1])
    edges = copy.where("__edge > 0").groupBy("__pid").count().agg(F.max("count")).first()[0]
    assert edges <= 2


def test_batches_and_odd_rows(spark, tasks, batch):
    """Neighbours over batch and task edges: NULL and NaN groups, NULL times,
    repeated rows, clashing column names, an output that replaces its source."""
    t = dt.datetime(2024, 5, 1)
    rows = [(g, t + dt.timedelta(days=i % 5) if i % 7 else None, i, f"s{i}", i % 3)
            for g in (None, float("nan"), 1.0, 2.0) for i in range(12)]
    d = spark.createDataFrame(rows, "tag double, ts timestamp, tie long, site string, edge long")
    kw = dict(lags={"p": "site", "pt": "ts"}, leads={"q": "tie", "nt": "ts"})
    a, b = plain_shift(d, ["tag"], **kw), W.sequence_shift(d, ["tag"], "ts", "tie", **kw)
    assert b.columns == a.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    a, b = plain_row_number(d, ["tag"]), W.sequence_row_number(d, ["tag"], "ts", "tie")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    third = W.nth_per_group(d, ["tag"], "ts", "tie", 3)
    assert sorted(map(str, a.filter("rn = 3").drop("rn").collect())) == sorted(map(str, third.collect()))
    same = W.sequence_shift(d, ["tag"], "ts", "tie", lags={"site": "site"})
    assert set(same.columns) == set(d.columns) and same.filter("site IS NULL").count() == 4
    twice = d.unionByName(d)
    assert W.sequence_shift(twice, ["tag"], "ts", "tie", lags={"p": "tie"}).filter("p = tie").count() == d.count()


def test_one_group_and_empty_table(spark, tasks):
    d = _det(spark)
    out = W.sequence_shift(d, [], "ts", "tie", lags={"p": "tie"})
    assert out.filter("p IS NULL").count() == 1 and out.count() == d.count()
    assert W.sequence_row_number(d, [], "ts", "tie").agg(F.max("rn")).first()[0] == d.count()
    none = d.limit(0)
    assert W.sequence_shift(none, ["tag"], "ts", "tie", lags={"p": "tie"}).collect() == []
    assert W.sequence_row_number(none, ["tag"], "ts", "tie").collect() == []
    assert W.nth_per_group(none, ["tag"], "ts", "tie", 2).collect() == []


def test_first_row_runs_no_job_before_an_action(spark):
    """The first row is an aggregate: nothing is written for it."""
    d = _det(spark)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "build only")
    try:
        W.first_per_group(d, ["tag"], "ts", "tie")
        assert list(tracker.getJobIdsForGroup("build")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_first_per_group_null_time_last(spark):
    t = dt.datetime(2024, 5, 1)
    d = spark.createDataFrame([(1, None, 1), (1, t, 2), (2, None, 3)], "tag long, ts timestamp, tie long")
    got = {r["tag"]: r["tie"] for r in W.first_per_group(d, ["tag"], "ts", "tie").collect()}
    assert got == {1: 2, 2: 3}


def test_row_number_bucketed_null_group(spark):
    t = dt.datetime(2024, 5, 1)
    rows = [(None, t + dt.timedelta(hours=h), h) for h in range(5)] + [(1, t, 10), (1, t, 11)]
    d = spark.createDataFrame(rows, "tag long, ts timestamp, tie long")
    a = W.sequence_row_number(d, ["tag"], "ts", "tie")
    b = plain_row_number(d, ["tag"])
    assert _rows(a, ["tie", "rn"]) == _rows(b, ["tie", "rn"])
    assert W.nth_per_group(d, ["tag"], "ts", "tie", 2).count() == 2
