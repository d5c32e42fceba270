"""Truth tables of the R NULL rules and scalar helpers (survey 1.3, 2.9)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from smolt.functions import nullsafe as N
from smolt.functions import scalars as S


def _one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("o")).collect()]


def test_isin_never_null(spark):
    rows = [("a",), ("b",), (None,)]
    assert _one(spark, N.isin_safe("x", ["a"]), rows, "x string") == [True, False, False]
    assert _one(spark, N.not_in_safe("x", ["a"]), rows, "x string") == [False, True, True]
    # NA %in% c(NA, ...) is TRUE
    assert _one(spark, N.null_or_in("x", ["a"]), rows, "x string") == [True, False, True]
    assert _one(spark, N.isin_safe("x", ["a", None]), rows, "x string") == [True, False, True]


def test_if_else_propagates_null(spark):
    rows = [(1,), (5,), (None,)]
    got = _one(spark, N.if_else(F.col("x") > 2, "hi", "lo"), rows, "x int")
    assert got == ["lo", "hi", None]


def test_count_distinct_counts_null_once(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "x string")
    assert df.agg(N.count_distinct_na("x")).first()[0] == 3
    df2 = spark.createDataFrame([("a",), ("b",)], "x string")
    assert df2.agg(N.count_distinct_na("x")).first()[0] == 2


def test_sum_strict(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", None), ("h", 2.0)], "k string, x double")
    got = {r["k"]: r["s"] for r in df.groupBy("k").agg(N.sum_strict("x").alias("s")).collect()}
    assert got == {"g": None, "h": 2.0}


def test_paste_prints_na(spark):
    rows = [("a", None), ("a", "b")]
    assert _one(spark, S.paste("x", "y", sep=" to "), rows, "x string, y string") == ["a to NA", "a to b"]


def test_strip_prefix_greedy(spark):
    assert _one(spark, S.strip_prefix("x"), [("A69-1604-37294",), ("nodash",), (None,)], "x string") \
        == ["37294", "nodash", None]


def test_parse_ts_two_formats_and_zone(spark):
    rows = [("2024-05-23 11:40",), ("2024-05-24 9:55:00 AM",), ("look onlogger",)]
    got = _one(spark, S.parse_ts("x", zone="America/Vancouver"), rows, "x string")
    # Vancouver is UTC-7 in May: the clock reading 11:40 is 18:40 UTC
    assert got[0] == dt.datetime(2024, 5, 23, 18, 40)
    assert got[1] == dt.datetime(2024, 5, 24, 16, 55)
    assert got[2] is None


def test_parse_date_invalid_is_null(spark):
    got = _one(spark, S.parse_date("x"), [("2024-02-29",), ("2023-02-29",), ("2024-02-31",)], "x string")
    assert got == [dt.date(2024, 2, 29), None, None]


def test_timediff_units(spark):
    rows = [(dt.datetime(2024, 1, 2, 0, 0, 0), dt.datetime(2024, 1, 1, 0, 0, 0))]
    for u, v in (("secs", 86400.0), ("mins", 1440.0), ("hours", 24.0), ("days", 1.0)):
        assert _one(spark, S.timediff("a", "b", u), rows, "a timestamp, b timestamp") == [v]


def test_recode_keeps_unmatched(spark):
    got = _one(spark, S.recode("x", {"ham.us": "1", "ham.ds": "0"}), [("ham.us",), ("hat.ds",), (None,)],
               "x string")
    assert got == ["1", "hat.ds", None]


def test_unit_speed_zero_time_is_null(spark):
    rows = [(1.2, 60.0), (1.2, 0.0)]
    got = _one(spark, S.unit_speed("d", "t", body_length=0.0012), rows, "d double, t double")
    assert got[0] == pytest.approx(1000.0 / 60.0) and got[1] is None


def test_null_tokens(spark):
    rows = [("na",), (" ",), ("NA",), ("3.5",)]
    assert _one(spark, S.null_tokens("x").try_cast("double"), rows, "x string") == [None, None, None, 3.5]
