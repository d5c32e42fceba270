"""Sources and sinks (survey 2.1).

Each query first writes files derived from a driver table into a fresh
folder under the session's shared checkpoint folder (never a machine-local
temp folder), in the layout the reference reads, then scans them back with
the operator under test. The written data grows with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from smolt.operators import aggregates as A
from smolt.operators import joins as J
from smolt.operators.histories import history_wide
from smolt.plans.registry import query
from smolt.plans.sqlparts import DET, SITES
from smolt.session import scratch_dir
from smolt.sources import csv as C
from smolt.sources import sinks as K
from smolt.sources import tables as TB

CUSTOMER_SCHEMA = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
    T.StructField("c_mktsegment", T.StringType())])


@query("scan_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv(spark, d):
    path = scratch_dir(spark, "customer-csv")
    TB.table(spark, d, "customer").write.option("header", True).csv(path)
    return C.scan_csv(spark, path, CUSTOMER_SCHEMA)


TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
LOG_HEADER = ["Date and Time (UTC)", "Receiver", "Transmitter"]


def _receiver_log(spark, d):
    det = TB.detections(spark, d)
    return det.select(F.date_format("ts", TS_FMT).alias(LOG_HEADER[0]),
                      F.concat(F.lit("VR2W-"), F.col("site")).alias(LOG_HEADER[1]),
                      F.concat(F.lit("A69-1604-"), F.col("tag").cast("string")).alias(LOG_HEADER[2]))


@query("scan_csv_names", f"""
SELECT ts AS date_and_time_utc, 'VR2W-' || site AS receiver, 'A69-1604-' || CAST(tag AS VARCHAR) AS transmitter FROM ({DET})""")
def scan_csv_names(spark, d):
    path = scratch_dir(spark, "receiver-csv")
    _receiver_log(spark, d).write.option("header", True).csv(path)
    df = C.scan_csv_names(spark, path)
    return df.withColumn("date_and_time_utc", F.to_timestamp_ntz("date_and_time_utc", F.lit(TS_FMT)))


LI_COLS = {"l_orderkey": T.LongType(), "l_linenumber": T.IntegerType(),
           "l_quantity": T.DoubleType(), "l_returnflag": T.StringType()}
#: Column orders of the directory's files.
LAYOUTS = [["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"],
           ["l_returnflag", "l_quantity", "l_orderkey", "l_linenumber"],
           ["l_quantity", "l_linenumber", "l_returnflag", "l_orderkey"]]


@query("scan_csv_dir_by_name", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def scan_csv_dir_by_name(spark, d):
    base = scratch_dir(spark, "release-dir")
    li = TB.table(spark, d, "lineitem").select(*LI_COLS)
    # every row goes to one folder, each folder with its own column order,
    # beside a file that the name pattern must skip
    place = F.pmod(F.hash("l_orderkey", "l_linenumber"), F.lit(len(LAYOUTS)))
    for k, cols in enumerate(LAYOUTS):
        li.filter(place == k).select(*cols).write.option("header", True).csv(f"{base}/layout_{k}")
    li.limit(1).select(F.lit("not a release file").alias("value")).write.text(f"{base}/notes")
    schema = T.StructType([T.StructField(c, t) for c, t in LI_COLS.items()])
    return C.scan_csv_dir_by_name(spark, base, r"\.csv$", schema, with_file=False) \
        .select(*LI_COLS)


LOG_FULL = ["Date and Time (UTC)", "Receiver", "Transmitter", "Transmitter Name",
            "Transmitter Serial", "Sensor Value", "Sensor Unit", "Station Name", "Latitude",
            "Longitude", "Transmitter Type", "Sensor Precision"]
@query("scan_csv_bom", f"""
SELECT ts, 'VR2W-' || site AS receiver, 'A69-1604-' || CAST(tag AS VARCHAR) AS transmitter,
       CAST(NULL AS DOUBLE) AS sensor_value, CAST(NULL AS VARCHAR) AS station_name FROM ({DET})""")
def scan_csv_bom(spark, d):
    path = scratch_dir(spark, "vr2w-log")
    log = _receiver_log(spark, d)
    # receiver export layout: BOM + 12 header names, rows with 3 values
    header = C.BOM + ",".join(LOG_FULL)
    log.select(F.concat_ws(",", *[F.col(f"`{c}`") for c in LOG_HEADER]).alias(header)) \
       .write.option("header", True).option("sep", "\t").csv(path)
    df = C.scan_csv_bom(spark, path, C.RECEIVER_LOG_SCHEMA)
    return df.select(F.to_timestamp_ntz("ts_text", F.lit(TS_FMT)).alias("ts"), "receiver",
                     "transmitter", "sensor_value", "station_name")


@query("inline_dim", f"""
SELECT s.site, s.rkm, CAST(count(*) AS BIGINT) AS n FROM ({DET}) d JOIN ({SITES}) s ON d.site = s.site GROUP BY s.site, s.rkm""")
def inline_dim(spark, d):
    j = J.join_dim(TB.detections(spark, d), TB.sites(spark), "site")
    return A.count_rows(j, ["site", "rkm"])


@query("sink_csv", """
SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS row_id, o_orderkey, o_custkey, o_totalprice FROM orders""")
def sink_csv(spark, d):
    path = scratch_dir(spark, "orders")
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    K.sink_csv(orders, path, order=["o_orderkey"], row_number=True)
    return C.scan_csv(spark, path, T.StructType([T.StructField("row_id", T.LongType()), *orders.schema.fields]))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("sink_history_freq", None)
def sink_history_freq(spark, d):
    from smolt.plans.q_survival import frequencies
    path = scratch_dir(spark, "history-deck")
    wide = history_wide(frequencies(spark, d), "grp", SEGMENTS)
    K.sink_history_freq(wide, [f"n_{s}" for s in SEGMENTS], path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def _deck_sql():
    from smolt.plans.q_survival import FREQ_SQL
    cnt = " || ' ' || ".join(
        f"CAST(sum(CASE WHEN grp = '{s}' THEN n ELSE 0 END) AS VARCHAR)" for s in SEGMENTS)
    return f"SELECT ch || ' ' || {cnt} || ';' AS line FROM ({FREQ_SQL}) GROUP BY ch"


def _register_deck_sql():
    from smolt.plans.registry import ORACLE
    ORACLE["sink_history_freq"] = " ".join(_deck_sql().split())


_register_deck_sql()
