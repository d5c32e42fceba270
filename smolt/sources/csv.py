"""Typed CSV scans (survey 2.1).

Inputs of the reference are CSV files whose schemas vary by file: column
order differs between files of one directory (survey D17), headers carry
spaces and brackets, receiver logs start with a byte-order mark and have
fewer values than header names. Schemas are declared, never inferred.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def r_names(names: Sequence[str]) -> list[str]:
    """R ``make.names``: invalid characters become '.', a leading digit
    gets an 'X' prefix (``Date and Time (UTC)`` -> ``Date.and.Time..UTC.``)."""
    out = []
    for n in names:
        n = n.lstrip(BOM)
        m = re.sub(r"[^0-9A-Za-z._]", ".", n)
        if not m or m[0].isdigit() or (m[0] == "." and len(m) > 1 and m[1].isdigit()):
            m = "X" + m
        out.append(m)
    return out


def snake_names(names: Sequence[str]) -> list[str]:
    """Spark-friendly names: lower case, runs of other characters -> '_'."""
    return [re.sub(r"[^0-9a-z]+", "_", n.lstrip(BOM).lower()).strip("_") for n in names]


def scan_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
             null_value: str = "", mode: str = "PERMISSIVE", **options) -> DataFrame:
    """``read_csv(path)`` with a declared schema (header row skipped).

    PERMISSIVE fills NULL for missing trailing values (short rows).
    """
    r = (spark.read.schema(schema).option("header", True).option("mode", mode)
         .option("nullValue", null_value))
    for k, v in options.items():
        r = r.option(k, v)
    return r.csv(path if isinstance(path, str) else list(path))


def scan_csv_names(spark: SparkSession, path: str, types: Mapping[str, str] | None = None,
                   style: str = "snake") -> DataFrame:
    """``read.csv(path)``: header names cleaned (R ``make.names`` with
    ``style='r'``), every column read as text, then typed with
    ``try_cast`` per ``types`` (cleaned name -> Spark type)."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    names = r_names(raw.columns) if style == "r" else snake_names(raw.columns)
    df = raw.toDF(*names)
    for c, t in (types or {}).items():
        df = df.withColumn(c, F.col(f"`{c}`").try_cast(t))
    return df


def _first_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line of each run of one file's lines."""
    last = None
    for batch in batches:
        files = batch.column("file")
        if not len(files):
            continue
        starts = pa.concat_arrays([pa.array([files[0].as_py() != last]), pc.not_equal(files[1:], files[:-1])])
        last = files[-1].as_py()
        yield pa.RecordBatch.from_arrays([files.filter(starts), batch.column("value").filter(starts)], ["file", "header"])


def headers_by_file(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """(header, files): the first lines of the directory's files whose name
    matches ``pattern``, each with the paths it heads. Tasks stream the lines
    and keep none but a file's first, which is the first of its split at
    offset 0. Empty files have no header."""
    lines = spark.read.option("recursiveFileLookup", True).text(directory).where(
        (F.col("_metadata.file_block_start") == 0) & F.col("_metadata.file_name").rlike(pattern)).select(
        "value", F.col("_metadata.file_path").alias("file"))
    first = lines.mapInArrow(_first_lines, "file string, header string")
    first = first.withColumn("header", F.regexp_replace("header", f"^{BOM}", ""))
    return first.where(F.col("header") != "").groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files"))


def scan_csv_dir_by_name(spark: SparkSession, directory: str, pattern: str,
                         schema: T.StructType, with_file: bool = True) -> DataFrame:
    """``list.files(dir, pattern) %>% map_dfr(read_csv)``: stack by *name*.

    Files are grouped by header line (a header lists the columns in that
    file's order); each group is one parallel scan whose schema follows
    the group's header, and the groups are unioned by name with missing
    columns as NULL. The headers are read and grouped in the cluster; the
    driver opens no file and gets the distinct headers with their paths.
    """
    groups = sorted(headers_by_file(spark, directory, pattern).collect(), key=lambda r: r["files"][0])
    if not groups:
        raise FileNotFoundError(f"no file with a header matching {pattern!r} under {directory}")
    by_name = {fld.name: fld for fld in schema.fields}
    parts = []
    for header, files in groups:
        cols = [c.strip() for c in next(csv.reader([header]))]
        sch = T.StructType([by_name.get(c, T.StructField(c, T.StringType())) for c in cols])
        df = scan_csv(spark, [unquote(f) for f in files], sch)  # metadata paths are URIs
        if with_file:
            df = df.withColumn("source_file", F.col("_metadata.file_name"))
        parts.append(df)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def scan_csv_bom(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Receiver-log CSV: BOM before the header, rows shorter than the
    header. The header row is dropped by position in each file, so the BOM
    never reaches a column name; missing trailing values become NULL."""
    return scan_csv(spark, path, schema)


# Column layout of a receiver export (12 header names; rows may stop after
# the first three values).
RECEIVER_LOG_SCHEMA = T.StructType(
    [T.StructField("ts_text", T.StringType()), T.StructField("receiver", T.StringType()),
     T.StructField("transmitter", T.StringType()), T.StructField("transmitter_name", T.StringType()),
     T.StructField("transmitter_serial", T.StringType()), T.StructField("sensor_value", T.DoubleType()),
     T.StructField("sensor_unit", T.StringType()), T.StructField("station_name", T.StringType()),
     T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
     T.StructField("transmitter_type", T.StringType()), T.StructField("sensor_precision", T.StringType())])
