"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every pipeline relies on: UTC session clock (timestamps are
# instants, display zones are explicit), AQE for runtime re-planning of
# shuffles and skewed joins, ANSI arithmetic (casts must be ``try_cast``).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "smolt", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's base settings.

    On a cluster pass ``master=None`` and let the launcher decide; the
    shuffle partition count should then be sized to the data (AQE
    coalesces small partitions at run time).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``smolt`` importable in every Python worker.

    Arrow UDFs and ``applyInPandas`` functions are pickled by reference to
    this package, so executors need it. The package is zipped once per
    driver process and added with ``addPyFile`` (Spark distributes it with
    the job; nothing is written to the executors' disks by us).
    """
    sc = spark.sparkContext
    if getattr(sc, "_smolt_shipped", False):
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="smolt-pyfiles-"), "smolt.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    sc._smolt_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    A cluster names a shared (distributed) folder in ``spark.checkpoint.dir``;
    it is read from the session and never overridden. Only a local session
    without one gets a private folder; on any other master an unset folder
    is an error, since executors could not see each other's files.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="smolt-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


_scratch: list[str] = []


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder; it lives
    until ``clean_scratch``."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _scratch.append(path)
    return path


def clean_scratch(spark: SparkSession) -> None:
    """Delete the scratch folders that this process made. Frames that read
    them must not be used afterwards."""
    while _scratch:
        p = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def reuse_small(df):
    """A small, bounded intermediate that a plan reads several times (e.g. a
    history frequency table feeding fits, sample sizes and goodness of
    fit): written once to the scratch folder and read from there, so later
    queries do not find it cached and lost executors cost nothing."""
    path = scratch_dir(df.sparkSession, "reused")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
