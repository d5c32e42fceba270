"""Shared helpers: column access, held-out folds, written intermediates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smolt.session import scratch_dir, ship_package

#: Characters that separate words, as a character class.
SPACE = r"\x20\x09-\x0D"


#: Rows of an Arrow batch: texts of a few KB then take some 10 MB in a Python worker.
BATCH_ROWS = 4000


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and bound the size of their batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n (a null key counts as '')."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` under the cluster's shared checkpoint folder and read it
    back: cuts the lineage, survives lost executors, and fixes row ids and
    row order for every later pass."""
    path = scratch_dir(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return a Python worker's freed memory to the system: the worker stays
    for later tasks, beside the JVM of its executor."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names starting with ``names`` that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
