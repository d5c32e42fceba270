"""Per-group sequence operators that stay bounded under key skew.

The reference orders detections per tag and looks at the previous / next
row (lag, lead) or the n-th row per group (``row_number() == n``). A plain
``Window.partitionBy(tag)`` puts every row of a tag into one task; if one
tag (a fish parked beside a receiver) holds a third of all rows, that task
holds a third of the data.

Here one range exchange sorts all rows by (group, time, tie), so a hot tag
is cut anywhere in its sequence, whatever its times are. Each task looks at
the neighbours of its own rows while they stream past in sorted batches,
and marks its first and last row. These edge rows, at most two per task,
are the only ones that need a neighbour from another task: one small window
over them stitches the sequence.

The sorted rows are written once to the session's shared scratch folder.
The bulk and the edges are both read from that copy: a second evaluation of
the range exchange would sample other bounds. Rows that a lost executor
takes with it are computed again before the copy is complete, never after.

Group columns are of atomic types; NULL is a group value like any other,
and NULL times sort last. Rows that agree in group, time and tie are kept
and ordered arbitrarily among themselves. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

_FIRST, _LAST = 1, 2  # marks of a task's first and last row


def _order_cols(order: str, tie: str | None) -> list[Column]:
    cols = [F.col(order).asc_nulls_last()]
    if tie:
        cols.append(F.col(tie).asc_nulls_last())
    return cols


def _order_key(order: str, tie: str | None) -> Column:
    # struct ordering compares field by field and puts NULL first; the
    # leading is-null flag sends NULL times last, as ``arrange`` does
    fields = [F.col(order).isNull(), F.col(order)] + ([F.col(tie)] if tie else [])
    return F.struct(*fields)


def _same_group(t: pa.Table, by: Sequence[str]) -> np.ndarray:
    """Whether each row has the group of the row before it (row 0: no)."""
    out = np.ones(t.num_rows, bool)
    out[:1] = False
    for c in by:
        x = t.column(c).combine_chunks()
        a, b = x[1:], x[:-1]
        eq = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        if pa.types.is_floating(x.type):
            eq = pc.or_(eq, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        out[1:] &= eq.to_numpy(zero_copy_only=False)
    return out


def _sorted_copy(df: DataFrame, by: Sequence[str], order: str, tie: str | None, per_task, extra: Sequence[StructField],
                 name: str) -> DataFrame:
    """The rows in (group, order, tie) order, as ``per_task`` maps the sorted
    batches of each task, written once and read back."""
    from smolt.session import scratch_dir, ship_package
    spark = df.sparkSession
    ship_package(spark)
    keys = [F.col(c).asc_nulls_last() for c in by] + _order_cols(order, tie)
    schema = StructType([StructField(f.name, f.dataType) for f in df.schema] + list(extra))
    path = scratch_dir(spark, name)
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(per_task, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def sequence_shift(df: DataFrame, by: Sequence[str], order: str, tie: str | None,
                   lags: Mapping[str, str] | None = None,
                   leads: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``lag``/``lead`` columns per group ordered by (order, tie).

    ``lags`` / ``leads`` map output column -> source column. One exchange
    of the rows; runs the job that writes the sorted copy.
    """
    moves = [(o, s, -1) for o, s in (lags or {}).items()] + [(o, s, 1) for o, s in (leads or {}).items()]
    names, by = list(df.columns), list(by)

    def shifted(t: pa.Table) -> pa.Table:
        same = _same_group(t, by)
        at = np.arange(t.num_rows)
        before = pa.array(at - 1, mask=~same)
        after = pa.array(at + 1, mask=~np.append(same[1:], False))
        for k, (_, s, way) in enumerate(moves):
            t = t.append_column(f"__s{k}", t.column(s).take(before if way < 0 else after))
        return t

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, tail, done = TaskContext.get().partitionId(), None, 0

        def marked(t: pa.Table, lo: int, hi: int, last: bool) -> Iterator[pa.RecordBatch]:
            edge = np.zeros(hi - lo, np.int32)
            edge[0] += _FIRST * (done == 0)
            edge[-1] += _LAST * last
            out = shifted(t).slice(lo, hi - lo)
            out = out.append_column("__edge", pa.array(edge))
            out = out.append_column("__pid", pa.array(np.full(hi - lo, pid, np.int32)))
            yield from out.combine_chunks().to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            # ``tail``: the last row that went out and the one that waits for its successor
            lo = tail.num_rows - 1 if tail is not None else 0
            t = pa.concat_tables([tail, t]).combine_chunks() if tail is not None else t
            hi = t.num_rows - 1
            if hi > lo:
                yield from marked(t, lo, hi, False)
                done += hi - lo
            tail = t.slice(max(hi - 1, 0))
        if tail is not None:
            yield from marked(tail, tail.num_rows - 1, tail.num_rows, True)

    extra = [StructField(f"__s{k}", df.schema[s].dataType) for k, (_, s, _) in enumerate(moves)]
    seen = _sorted_copy(df, by, order, tie, per_task, extra + [StructField(c, IntegerType()) for c in ("__edge", "__pid")], "sequence")
    w = Window.orderBy("__pid", F.col("__edge") == _LAST)  # at most two rows of each task
    group = F.struct(F.lit(0), *[F.col(c) for c in by])
    first, last = F.col("__edge").bitwiseAND(_FIRST) > 0, F.col("__edge").bitwiseAND(_LAST) > 0
    edges = seen.where("__edge > 0").withColumns({
        "__before": F.coalesce(F.lag(group).over(w) == group, F.lit(False)),
        "__after": F.coalesce(F.lead(group).over(w) == group, F.lit(False)),
        **{f"__t{k}": (F.lag(s) if way < 0 else F.lead(s)).over(w) for k, (_, s, way) in enumerate(moves)}})
    outer = {k: first & F.col("__before") if way < 0 else last & F.col("__after") for k, (_, _, way) in enumerate(moves)}
    keep = [c for c in names if c not in {o for o, _, _ in moves}]
    return seen.where("__edge = 0").select(*keep, *[F.col(f"__s{k}").alias(o) for k, (o, _, _) in enumerate(moves)]).unionByName(
        edges.select(*keep, *[F.when(outer[k], F.col(f"__t{k}")).otherwise(F.col(f"__s{k}")).alias(o) for k, (o, _, _) in enumerate(moves)]))


def _numbered(df: DataFrame, by: Sequence[str], order: str, tie: str | None, out: str, most: int | None = None) -> DataFrame:
    """``row_number()`` per group; with ``most``, at least the rows numbered
    up to it, so that only these are written.

    A group that a task finds open has its earlier rows at the end of the
    tasks before: the sum of these tasks' last numbers is its offset.
    """
    by = list(by)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, run, opened = TaskContext.get().partitionId(), None, 0, True

        def finish(t: pa.Table, edge: bool) -> Iterator[pa.RecordBatch]:
            t = t.append_column("__last", pa.array(np.full(t.num_rows, edge)))
            t = t.append_column("__pid", pa.array(np.full(t.num_rows, pid, np.int32)))
            yield from t.combine_chunks().to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if last is None:
                same = _same_group(t, by)
                same[0] = True  # the task's first group is open until it ends
            else:
                raw = last.select(t.column_names)
                same = _same_group(pa.concat_tables([raw, t]), by)[1:]
                if most is None or run <= most:
                    yield from finish(last, False)
            at = np.arange(t.num_rows)
            start = np.maximum.accumulate(np.where(same, -run, at))
            number = at - start + 1
            first_group = np.logical_and.accumulate(same) & opened
            t = t.append_column("__run", pa.array(number.astype(np.int64))).append_column("__open", pa.array(first_group))
            run, opened, last = int(number[-1]), bool(first_group[-1]), t.slice(t.num_rows - 1)
            t = t.slice(0, t.num_rows - 1)
            if most is not None:
                t = t.filter(pa.array(number[:-1] <= most))
            if t.num_rows:
                yield from finish(t, False)
        if last is not None:
            yield from finish(last, True)

    seen = _sorted_copy(df, by, order, tie, per_task, [
        StructField("__run", LongType()), StructField("__open", BooleanType()),
        StructField("__last", BooleanType()), StructField("__pid", IntegerType())], "sequence-numbers")
    # a struct key groups NULL tag values together
    group = F.struct(F.lit(0), *[F.col(c) for c in by])
    ends = seen.select("__pid", group.alias("__g"), "__run", "__last", "__open")
    earlier = Window.partitionBy("__g").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # one first and one last row of each task: the first one takes the sum of the last ones before
    heads = ends.where("__open AND __run = 1").select("__pid", "__g", F.lit(0).cast("long").alias("n"), F.lit(True).alias("head"))
    lasts = ends.where("__last").select("__pid", "__g", F.col("__run").alias("n"), F.lit(False).alias("head"))
    per_task_rows = heads.unionByName(lasts).groupBy("__g", "__pid").agg(F.sum("n").alias("n"), F.max("head").alias("head"))
    offsets = (per_task_rows.withColumn("__off", F.sum("n").over(earlier)).where("head AND __off > 0").select("__pid", "__off"))
    # at most one row of each range partition, a number the session sets
    done = seen.join(F.broadcast(offsets), "__pid", "left")
    number = F.col("__run") + F.when(F.col("__open"), F.coalesce("__off", F.lit(0))).otherwise(0)
    return done.select(*[c for c in df.columns if c != out], number.cast("int").alias(out))


def sequence_row_number(df: DataFrame, by: Sequence[str], order: str, tie: str | None,
                        out: str = "rn") -> DataFrame:
    """``row_number()`` per group in (order, tie) order, skew-bounded.

    Numbers within the sorted task plus, for the group that a task finds
    open, its rows in earlier tasks. Runs the job that writes the copy.
    """
    return _numbered(df, by, order, tie, out)


def first_per_group(df: DataFrame, by: Sequence[str], order: str, tie: str | None,
                    cols: Sequence[str] | None = None) -> DataFrame:
    """``arrange(order) %>% filter(row_number() == 1)`` per group.

    An aggregate (``min_by``) with map-side partial aggregation: a hot
    group is reduced inside every input task before the shuffle.
    """
    cols = [c for c in (cols or df.columns) if c not in by]
    key = _order_key(order, tie)
    agg = df.groupBy(*by).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), key).alias("__r"))
    return agg.select(*by, *[F.col("__r")[c].alias(c) for c in cols])


def nth_per_group(df: DataFrame, by: Sequence[str], order: str, tie: str | None, n: int) -> DataFrame:
    """``filter(row_number() == n)`` per group.

    The n-th row of a group is among the first n that its sorted task holds
    of it, so each task writes at most these and its last row.
    """
    if n == 1:
        return first_per_group(df, by, order, tie)
    return _numbered(df, by, order, tie, "__rn", most=n).filter(F.col("__rn") == n).select(*df.columns)
