"""CSV sources: name cleaning, by-name directory scan, BOM receiver logs."""

import os

import pytest
from pyspark.sql import types as T

from smolt.session import scratch_dir
from smolt.sources import csv as C


def test_r_names():
    assert C.r_names(["﻿Date and Time (UTC)", "Receiver", "1st", " lactate"]) == \
        ["Date.and.Time..UTC.", "Receiver", "X1st", ".lactate"]
    assert C.snake_names(["Date and Time (UTC)", "tag.id"]) == ["date_and_time_utc", "tag_id"]


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_dir_scan_by_header_name(spark):
    base = scratch_dir(spark, "pit-dir").replace("file:", "")
    # three column orders (as in the PIT release files) and a file to skip
    _write(f"{base}/a_control.csv", "release.date,release.time,id.prefix,last.four,treatment,release.location\n"
                                    "2024-05-23,11:40,900,f9c3,control,ham.us\n")
    _write(f"{base}/b_release.csv", "release.date,release.time,release.location,id.prefix,last.four,treatment\n"
                                    "2024-05-23,13:20,ham.us,900,f953,archimedes1\n"
                                    "2024-05-23,13:20,ham.us,900,fc41,archimedes1\n")
    _write(f"{base}/c_release.csv", "release.date,release.time,id.prefix,last.four,release.location,treatment\n"
                                    "2024-05-24,9:55:00 AM,900,fd99,ham.ds,archimedes2\n")
    _write(f"{base}/notes.txt", "not,a,release\n")
    _write(f"{base}/d_empty.csv", "")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in
                           ["release.date", "release.time", "id.prefix", "last.four", "treatment",
                            "release.location"]])
    df = C.scan_csv_dir_by_name(spark, base, r"\.csv$", schema)
    rows = sorted((r["last.four"], r["treatment"], r["release.location"], r["source_file"])
                  for r in df.collect())
    assert rows == [("f953", "archimedes1", "ham.us", "b_release.csv"),
                    ("f9c3", "control", "ham.us", "a_control.csv"),
                    ("fc41", "archimedes1", "ham.us", "b_release.csv"),
                    ("fd99", "archimedes2", "ham.ds", "c_release.csv")]


def test_dir_scan_reads_headers_in_tasks(spark):
    """Names with spaces, a byte-order mark, quoted commas, a split file, sub-folders."""
    base = scratch_dir(spark, "many files").replace("file:", "")
    rows = "".join(f'"x, {i}",{i}\n' for i in range(3000))
    _write(f"{base}/one 1.csv", "\ufeffname,n\n" + rows)
    _write(f"{base}/sub folder/two.csv", "n,name\n7,y\nn,name\n")
    _write(f"{base}/sub folder/three.csv", "name,extra\nz,1\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        heads = {r["header"]: len(r["files"]) for r in C.headers_by_file(spark, base, r"\.csv$").collect()}
        df = C.scan_csv_dir_by_name(spark, base, r"\.csv$", T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.IntegerType())]))
        got = sorted(((r["name"], r["n"], r["extra"]) for r in df.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert heads == {"name,n": 1, "n,name": 1, "name,extra": 1}
    # a later line that equals the header is a row, whose number does not parse
    assert got == sorted([(f"x, {i}", i, None) for i in range(3000)] + [("y", 7, None), ("name", None, None), ("z", None, "1")], key=str)
    with pytest.raises(FileNotFoundError):
        C.scan_csv_dir_by_name(spark, base, r"\.parquet$", df.schema)


def test_headers_take_no_sort_of_the_lines(spark):
    """Many small files in one task, equal headers in a row, a blank first line."""
    base = scratch_dir(spark, "heads").replace("file:", "")
    for k in range(40):
        _write(f"{base}/f{k:02d}.csv", ("a,b\n" if k % 3 else "b,a\n") + "a,b\n" * (k * 300))
    _write(f"{base}/blank.csv", "\na,b\n")
    heads = C.headers_by_file(spark, base, r"\.csv$")
    got = {r["header"]: [os.path.basename(f) for f in r["files"]] for r in heads.collect()}
    assert got == {h: [f"f{k:02d}.csv" for k in range(40) if (k % 3 > 0) == (h == "a,b")] for h in ("a,b", "b,a")}
    plan = heads._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Sort" not in plan, plan


def test_bom_short_rows(spark):
    base = scratch_dir(spark, "vr2w").replace("file:", "")
    header = ",".join(["Date and Time (UTC)", "Receiver", "Transmitter", "Transmitter Name",
                       "Transmitter Serial", "Sensor Value", "Sensor Unit", "Station Name", "Latitude",
                       "Longitude", "Transmitter Type", "Sensor Precision"])
    _write(f"{base}/VR2W_108656.csv", "﻿" + header + "\n2024-05-07 17:09:59,VR2W-108656,A69-1604-37294\n")
    r = C.scan_csv_bom(spark, base, C.RECEIVER_LOG_SCHEMA).collect()
    assert len(r) == 1 and r[0]["ts_text"] == "2024-05-07 17:09:59"
    assert r[0]["transmitter"] == "A69-1604-37294" and r[0]["sensor_value"] is None
