"""Join operators (survey 2.4).

Dimension tables with a proven size bound (site map, release groups,
literal lists) are broadcast explicitly. Everything else is left to the
planner: AQE switches a sort-merge join to a broadcast join only after it
has *measured* the smaller side, and splits skewed partitions of the
large side (``spark.sql.adaptive.skewJoin.enabled``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from smolt.functions.scalars import epoch_micros, timediff


def checked_broadcast(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Broadcast hint only when the optimizer's size estimate of ``df`` is
    within ``max_bytes`` (default: the session's
    ``spark.sql.autoBroadcastJoinThreshold``; a disabled broadcast gives no
    hint). The estimate needs no job; it is exact for literal relations and
    file-size based for scans. Above the limit the plain join is returned
    and AQE chooses at run time from measured sizes."""
    if max_bytes is None:
        max_bytes = int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= max_bytes else df


def join_dim(df: DataFrame, dim: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Inner join to a small dimension, broadcast behind a size check."""
    return df.join(checked_broadcast(dim), on, "inner")


def join_suffixed(x: DataFrame, y: DataFrame, on: Sequence[str],
                  suffixes: tuple[str, str] = ("_x", "_y"), how: str = "inner") -> DataFrame:
    """``merge(x, y, by=)``: shared non-key columns get ``.x`` / ``.y``
    suffixes (written ``_x`` / ``_y``)."""
    on = list(on)
    shared = (set(x.columns) & set(y.columns)) - set(on)
    xr = x.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    yr = y.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return xr.join(yr, on, how)


def full_join(x: DataFrame, y: DataFrame, on: Sequence[str]) -> DataFrame:
    """``full_join(x, y, by=c(...))``: keys coalesced, unmatched rows kept."""
    return x.join(y, list(on), "full")


def semi_join(x: DataFrame, y: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """``filter(x, k %in% y$k)``."""
    return x.join(y, on, "left_semi")


def anti_join_keep_null(x: DataFrame, y: DataFrame, key: str) -> DataFrame:
    """``filter(x, !k %in% y$k)``: a NULL key is kept unless ``y`` holds a
    NULL key too (``NA %in% c(NA)`` is TRUE) — a null-safe anti join."""
    ykeys = y.select(F.col(key).alias("__k")).distinct()
    return x.join(ykeys, x[key].eqNullSafe(ykeys["__k"]), "left_anti")


def exists_flag(x: DataFrame, y: DataFrame, key: str, out: str,
                yes="Yes", no="No") -> DataFrame:
    """``mutate(f = ifelse(k %in% y$k, yes, no))``: left join to the
    distinct keys (aggregated map-side, so a hot key costs one row)."""
    keys = y.select(F.col(key).alias("__k")).where(F.col("__k").isNotNull()).distinct() \
            .withColumn("__hit", F.lit(True))
    j = x.join(keys, x[key] == keys["__k"], "left")
    return j.withColumn(out, F.when(F.col("__hit"), F.lit(yes)).otherwise(F.lit(no))) \
            .drop("__k", "__hit")


def join_after(events: DataFrame, anchors: DataFrame, key: str, ts: str, anchor_ts: str,
               strict: bool = True) -> DataFrame:
    """Events joined to their key's anchor instant, keeping those after it.

    The intent of the reference's pre-release filter (survey D1): each
    detection is compared with *its own* tag's release time.
    """
    j = events.join(anchors, key, "inner")
    cond = F.col(ts) > F.col(anchor_ts) if strict else F.col(ts) >= F.col(anchor_ts)
    return j.filter(cond)


def join_back_to_agg(df: DataFrame, by: Sequence[str], aggs: dict, attrs: DataFrame,
                     on: str | Sequence[str]) -> DataFrame:
    """``group_by(by) %>% summarise(...) %>% merge(attrs, by=on)``."""
    agg = df.groupBy(*by).agg(*[v.alias(k) for k, v in aggs.items()])
    return agg.join(attrs, on, "inner")


def elapsed_since(first_events: DataFrame, anchors: DataFrame, key: str, ts: str,
                  anchor_ts: str, out: str, units: str = "hours") -> DataFrame:
    """Join first events to anchors and add ``difftime(ts, anchor, units)``."""
    return first_events.join(anchors, key, "inner") \
        .withColumn(out, timediff(F.col(ts), F.col(anchor_ts), units))


def dup_key_report(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once (survey D13: short PIT ids repeat
    across releases, so a join on them fans out and can pick the wrong
    release). An aggregate with partial aggregation; one row per repeated
    key with its count."""
    keys = [key] if isinstance(key, str) else list(key)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") > 1))


#: Bucket of instants that are NULL; they sort last and match nothing.
_NO_TIME = 2 ** 62


def last_before(samples: DataFrame, releases: DataFrame, key: str, sample_ts: str, release_ts: str,
                ties: Sequence[str] = (), bucket_seconds: int = 30 * 86400) -> DataFrame:
    """Best match of repeated keys (survey D13): every sample with the last
    release of its key at or before the sample, NULL columns if there is
    none. Of releases at the same instant the smallest by ``ties`` wins
    (NULLs last). A NULL key or instant matches nothing; column names of the
    two sides must differ but for the key.

    Samples and releases are merged in time order per (key, bucket of
    ``bucket_seconds``), so a key with very many rows is spread over its
    buckets. Each bucket's last release is then carried to the later buckets
    of the key, over one row per bucket; no row meets more than its bucket,
    and no sample is multiplied by the releases of its key.
    """
    shared = (set(samples.columns) & set(releases.columns)) - {key}
    if shared:
        raise ValueError(f"columns on both sides: {sorted(shared)}")
    mine, theirs = [c for c in samples.columns if c != key], [c for c in releases.columns if c != key]
    s_type, r_type = (df.select(F.struct(*cols)).schema[0].dataType for df, cols in ((samples, mine), (releases, theirs)))
    kind = samples.schema[key].dataType
    s = samples.select(F.col(key).alias("__k"), F.struct(*mine).alias("__s"), F.lit(None).cast(r_type).alias("__r"),
                       F.col(sample_ts).cast("timestamp").alias("__t"))
    r = releases.where(F.col(key).isNotNull() & F.col(release_ts).isNotNull()).select(
        F.col(key).cast(kind).alias("__k"), F.lit(None).cast(s_type).alias("__s"), F.struct(*theirs).alias("__r"),
        F.col(release_ts).cast("timestamp").alias("__t"))
    d = s.unionByName(r).withColumn("__b", F.coalesce(F.floor(epoch_micros("__t") / F.lit(bucket_seconds * 1_000_000)), F.lit(_NO_TIME)).cast("long"))
    own = Window.partitionBy("__k", "__b")
    # releases before samples of the same instant, the one that wins last
    order = own.orderBy(F.col("__t").asc_nulls_last(), F.col("__s").isNotNull(), *[F.col("__r")[c].desc_nulls_first() for c in ties])
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumns({"__in": F.last("__r", True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
                       "__end": F.last("__r", True).over(order.rowsBetween(*whole)), "__n": F.row_number().over(order)})
    edge = F.col("__n") == 1
    buckets = Window.partitionBy("__k", F.when(edge, F.lit(None)).otherwise(F.col("__b"))).orderBy("__b")
    d = d.withColumn("__carry", F.when(edge, F.last("__end", True).over(buckets.rowsBetween(Window.unboundedPreceding, -1))))
    d = d.withColumn("__carry", F.first("__carry", True).over(own))
    hit = F.when(F.col("__t").isNotNull() & F.col("__k").isNotNull(), F.coalesce("__in", "__carry"))
    d = d.where(F.col("__s").isNotNull()).withColumn("__m", hit)
    return d.select(F.col("__k").alias(key), *[F.col("__s")[c].alias(c) for c in mine], *[F.col("__m")[c].alias(c) for c in theirs])
