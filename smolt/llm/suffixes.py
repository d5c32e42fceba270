"""Repeated passages by sparse suffix arrays.

A passage is ``least`` words or longer and occurs twice or more. Of every
run of ``WINDOW`` neighbouring suffixes the one whose first words have the
smallest hash is retained (its position follows from the content alone), so
each occurrence of a passage retains the same suffix. Retained suffixes are
sorted by their first words and compared with their neighbours; those that
agree are extended left and right to all windows of ``least`` words around
them, which are sorted and compared in the same way. Runs of repeated
windows are the passages.

Neighbours alone would lose passages: of three suffixes in order the middle
one may differ from both on the left while the outer two agree there. The
second sort therefore takes every window around a match, whichever suffix
it agrees with.

Suffixes are candidates, keyed by 64 bits of their first words; windows are
compared by 128 bits of all their words, as 64 would confuse some windows of
a corpus of 10^13 words. Both sorts are range partitioned on (hash,
document, position): a hash that a third of all rows share is spread over
many tasks, which stream their rows; the first and last row of each task
settle what neighbours on other tasks say.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smolt.llm.common import fresh, give_back, written
from smolt.llm.tokens import CHECK_BASE, Words, bytes_of, text_chunks

LEAST = 50
#: Suffixes of which one is retained; a retained suffix is known by LEAST - WINDOW + 1 words.
WINDOW = 25


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of x[i:i+w] for every full window."""
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:len(x) - span], x[span:])
        span *= 2
    rest = w - span
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def anchors(words: Words, least: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of ``least`` words inside a text: its first word, and
    the retained suffix it holds; and the hash of each suffix's first words."""
    key = words.grams(least - window + 1)
    if len(words.hash) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), key
    place = np.arange(len(key), dtype=np.uint64)
    low = np.uint64(np.iinfo(np.uint32).max)
    at = (_sliding_least((key & ~low) | place, window) & low).astype(np.int64)
    text = np.repeat(np.arange(len(words.row) - 1), np.diff(words.row))
    first = np.arange(len(at))
    inside = text[first] == text[first + least - 1]
    return first[inside], at[inside], key


def _identity(id_col: str, text_col: str) -> tuple[Column, Column]:
    return F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h")


def agreeing(rows: DataFrame) -> DataFrame:
    """Rows (key, id, h, p) whose key another row has: (id, h, p, earlier),
    where ``earlier`` tells that one comes before it in the order of (id,
    h, p). Equal rows count once. A column ``check`` belongs to the key. Each
    task streams its sorted rows and holds back one."""
    keys = [c for c in ("key", "check") if c in rows.columns]
    names = [*keys, "id", "h", "p"]
    order = [*map(F.col, keys), F.col("id").asc_nulls_last(), F.col("h"), F.col("p")]

    def same(t: pa.Table, columns: list[str]) -> np.ndarray:
        """Rows 1.. that equal the row before in long columns."""
        out = np.ones(max(0, t.num_rows - 1), bool)
        for c in columns:
            x = t.column(c).to_numpy()
            out &= x[1:] == x[:-1]
        return out

    def marked(t: pa.Table, prev: np.ndarray, agrees: np.ndarray, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = np.flatnonzero(agrees | edge)
        if len(keep):
            t = t.take(pa.array(keep))
            pid = np.full(len(keep), TaskContext.get().partitionId(), np.int32)
            for n, c in enumerate(keys):  # only edges are compared again
                t = t.set_column(n, c, pa.array(t.column(c).to_numpy(), mask=~edge[keep]))
            for n, x in (("earlier", prev[keep]), ("agrees", agrees[keep]), ("edge", edge[keep]), ("pid", pid)):
                t = t.append_column(n, pa.array(x))
            yield from t.combine_chunks().to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_prev, begun = None, False, False
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            twin = np.flatnonzero(same(t, [*keys, "h", "p"]))
            new = np.ones(t.num_rows, bool)
            if len(twin):
                ids = t.column("id")
                new[1 + twin] = [x != y for x, y in zip(ids.take(pa.array(twin)).to_pylist(), ids.take(pa.array(twin + 1)).to_pylist())]
            t = t.take(pa.array(np.flatnonzero(new)))
            nxt = same(t, keys)
            prev = np.concatenate(([held_prev], nxt))
            edge = np.zeros(len(nxt), bool)
            if len(nxt):
                edge[0], begun = not begun, True
                yield from marked(t.slice(0, len(nxt)), prev[:-1], prev[:-1] | nxt, edge)
            held, held_prev = t.take(pa.array([len(nxt)])), prev[-1]
        if held is not None:
            last = np.array([held_prev])
            yield from marked(held, last, last, np.ones(1, bool))

    kind = rows.schema["id"].dataType.simpleString()
    head = "".join(f"{c} long, " for c in keys)
    seen = written(rows.select(*names).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        compare, f"{head}id {kind}, h long, p int, earlier boolean, agrees boolean, edge boolean, pid int"), "suffix-runs")
    key = Window.partitionBy(*keys)
    edges = (seen.where("edge")  # two rows of each task
             .withColumn("low", F.min("pid").over(key)).withColumn("high", F.max("pid").over(key))
             .withColumn("earlier", F.col("earlier") | (F.col("low") < F.col("pid")))
             .withColumn("agrees", F.col("agrees") | (F.col("low") < F.col("high"))).where("agrees"))
    out = ("id", "h", "p", "earlier")
    return seen.where("agrees AND NOT edge").select(*out).unionByName(edges.select(*out))


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*_identity(id_col, text_col), F.col(text_col).cast("string").cast("binary").alias("text"))


def retained(docs: DataFrame, least: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """(key, id, h, p) of all retained suffixes: p is a word position. A
    task lists rows of equal id and text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed: set = set()
        for b in batches:
            data, at = bytes_of(b.column(2))
            who = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for lo, hi in text_chunks(at):
                w = Words(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                _, p, key = anchors(w, least, window)
                p = np.unique(p)
                text = np.searchsorted(w.row, p, "right") - 1
                new = np.array([x not in listed and not listed.add(x) for x in who[lo:hi]], bool)
                p, text = p[new[text]], text[new[text]]
                take = pa.array(lo + text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[p].view(np.int64)), b.column(0).take(take), b.column(1).take(take),
                     pa.array((p - w.row[text]).astype(np.int32))], ["key", "id", "h", "p"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return _scan(docs, id_col, text_col).mapInArrow(run, f"key long, id {kind}, h long, p int")


def _by_document(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``docs`` (id, h, ...) that have rows, with those rows as a list."""
    listed = rows.groupBy("id", "h").agg(F.collect_list(F.struct("p", "earlier")).alias("found"))
    d, x = docs.alias("d"), listed.alias("x")
    return d.join(x, F.col("d.id").eqNullSafe(F.col("x.id")) & (F.col("d.h") == F.col("x.h"))).select("d.*", "x.found")


def repeated_windows(docs: DataFrame, least: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """(id, h, p, earlier) of every window of ``least`` words that occurs
    twice or more."""
    matched = agreeing(retained(docs, least, window, id_col, text_col))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed: set = set()
        for b in batches:
            data, at = bytes_of(b.column(2))
            who = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for i in range(b.num_rows):
                if who[i] in listed:
                    continue
                listed.add(who[i])
                w = Words(data[at[i]:at[i + 1]], np.array([0, at[i + 1] - at[i]]))
                first, p, _ = anchors(w, least, window)
                hit = np.zeros(len(w.hash) + 1, bool)
                hit[b.column(3)[i].values.field("p").to_numpy()] = True
                s = first[hit[p]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.grams(least)[s].view(np.int64)), pa.array(w.grams(least, CHECK_BASE)[s].view(np.int64)),
                     pa.array([who[i][0]] * len(s), b.schema.field(0).type), pa.array(np.full(len(s), who[i][1])),
                     pa.array(s.astype(np.int32))], ["key", "check", "id", "h", "p"])

    kind = docs.schema[id_col].dataType.simpleString()
    around = _by_document(matched, _scan(docs, id_col, text_col)).select("id", "h", "text", "found")
    return agreeing(around.mapInArrow(extend, f"key long, check long, id {kind}, h long, p int"))


def _runs(starts: np.ndarray, least: int) -> list[dict]:
    """Union of windows as spans of words."""
    s = np.sort(starts)
    if not len(s):
        return []
    gap = np.flatnonzero(np.diff(s) > least)
    lo, hi = s[np.concatenate(([0], gap + 1))], s[np.append(gap, len(s) - 1)] + least
    return [{"start": int(a), "length": int(z - a)} for a, z in zip(lo, hi)]


def passages(docs: DataFrame, least: int = LEAST, window: int = WINDOW, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Repeated passages of every document that has one.

    Columns: id, h (hash of the text), spans (all words covered by a window
    of ``least`` words that occurs twice or more, in any documents or in
    one) and cuts (those covered by a window that occurs earlier, in the
    order of id, nulls last, text hash and position); both as (start,
    length) in words. Words are compared as they are; blanks between them
    do not matter. Null, empty and short texts have no passage, very long
    ones are read whole. Rows of
    equal id and text are one document. Other columns are not read; an
    empty table gives no rows.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
        for b in batches:
            spans, cuts = [], []
            for i in range(b.num_rows):
                v = b.column(2)[i].values
                p, e = v.field("p").to_numpy(), v.field("earlier").to_numpy(zero_copy_only=False)
                spans.append(_runs(p, least))
                cuts.append(_runs(p[e], least))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, span), pa.array(cuts, span)],
                                             ["id", "h", "spans", "cuts"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = repeated_windows(docs, least, window, id_col, text_col)
    listed = found.groupBy("id", "h").agg(F.collect_list(F.struct("p", "earlier")).alias("found"))
    span = "array<struct<start:int,length:int>>"
    return listed.mapInArrow(merge, f"id {kind}, h long, spans {span}, cuts {span}")


def without_words(text: bytes, cuts: list[tuple[int, int]]) -> bytes:
    """The text without the words of ``cuts`` (start, length); each cut also
    takes the blanks up to the next word."""
    w = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    out, at = [], 0
    for start, length in cuts:
        out.append(text[at:w.start[start]])
        at = w.start[start + length] if start + length < len(w.start) else len(text)
    return b"".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, least: int = LEAST, window: int = WINDOW, id_col: str = "doc_id",
                   text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``docs`` with every repeated passage cut but where it occurs first.

    All rows and columns stay; only the text changes (and the character
    count, if ``chars_col`` names it). A text that is one repeat becomes
    empty. See ``passages`` for odd inputs.
    """
    id_, h, cuts = fresh(docs, "_id", "_h", "_cuts")
    found = passages(docs, least, window, id_col, text_col).where(F.size("cuts") > 0).select(
        F.col("id").alias(id_), F.col("h").alias(h), F.col("cuts").alias(cuts))
    own = _identity(id_col, text_col)[1]
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col(id_)) & (own == F.col(h)), "left")

    @F.udf("string", useArrow=True)
    def cut(text, spans):  # other rows' texts stay in the JVM
        return None if spans is None else without_words(text.encode(), [(s["start"], s["length"]) for s in spans]).decode()

    text = F.col(text_col).cast("string")
    kept = F.when(F.col(cuts).isNull(), text).otherwise(cut(F.when(F.col(cuts).isNotNull(), text), F.col(cuts)))
    out = joined.withColumn(text_col, kept)
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(cuts).isNull(), F.col(chars_col)).otherwise(
            F.length(text_col).cast(docs.schema[chars_col].dataType)))
    return out.select(*docs.columns)
