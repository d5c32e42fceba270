"""Ordering operators (survey 2.7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_nulls_last(df: DataFrame, cols: Sequence[str | Column],
                    descending: Sequence[str] = ()) -> DataFrame:
    """``arrange``: NULLs last in both directions, as R does."""
    keys = []
    for c in cols:
        col = F.col(c) if isinstance(c, str) else c
        keys.append(col.desc_nulls_last() if (isinstance(c, str) and c in descending)
                    else col.asc_nulls_last())
    return df.orderBy(*keys)


def rank_column(c: str, levels: Sequence[str], out: str) -> Column:
    """Position of ``c`` in a declared level list (factor order); unknown
    values rank after all levels."""
    m = F.create_map(*[x for i, v in enumerate(levels) for x in (F.lit(v), F.lit(i + 1))])
    return F.coalesce(F.try_element_at(m, F.col(c)), F.lit(len(levels) + 1)).alias(out)


def global_row_number(df: DataFrame, order: Sequence[str], out: str = "row_id") -> DataFrame:
    """Consecutive 1..N over a total order without a single-task window.

    ``order`` must be total (rows that tie on it are numbered arbitrarily).
    The range-partitioned, sorted rows are written once to the session's
    shared scratch folder with their position (task number and place in the
    task), and both readers, the task row counts and the rows themselves,
    read that one copy. A second run of the range exchange would sample
    other bounds, so the two must never come from separate evaluations.
    Partitions follow ``spark.sql.shuffle.partitions``.
    """
    from smolt.session import scratch_dir
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_last() for c in order]
    # after the range exchange and a local sort, monotonically_increasing_id
    # is (partition << 33) + position
    placed = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                .withColumn("__mid", F.monotonically_increasing_id()))
    path = scratch_dir(spark, "row-numbers")
    placed.write.parquet(path)
    r = spark.read.schema(placed.schema).parquet(path)
    r = r.withColumns({"__pid": F.shiftright("__mid", 33),
                       "__lrn": F.col("__mid") - F.shiftleft(F.shiftright("__mid", 33), 33) + 1})
    counts = r.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    wc = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(wc), F.lit(0)).alias("__off"))
    j = r.join(F.broadcast(offsets), "__pid")
    return j.withColumn(out, (F.col("__off") + F.col("__lrn")).cast("long")) \
            .drop("__pid", "__lrn", "__off", "__mid")


def page_assign(df: DataFrame, key: str, per_page: int = 16) -> DataFrame:
    """Pages of ``per_page`` keys in key order: ``ceiling(rank / per_page)``.

    Ranks the distinct-key table only (never the detections).
    """
    keys = df.select(key).distinct()
    ranked = global_row_number(keys, [key], "key_rank")
    return ranked.withColumn("page", F.ceil(F.col("key_rank") / F.lit(per_page)).cast("long"))
