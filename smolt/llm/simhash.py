"""SimHash near-duplicates by a self-join of the binary fingerprint trie.

Distinct fingerprints form a binary trie (bit 63 first). Pairs of nodes
are walked together from (root, root); a pair of children that takes
different turns costs one bit, and a pair whose cost exceeds the budget is
dropped with everything below it. The top of the trie is cut into cells of
bounded size; every pair of cells that the budget allows is one task, which
finishes the walk on sorted arrays and returns a spanning forest of its
links, never all pairs. Copies share one fingerprint and join as one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smolt.llm.common import fresh, give_back, written
from smolt.llm.graph import Forest, components
from smolt.llm.packing import chunks

SEED = 42
#: Most fingerprints of a cell, node pairs of one step, and leaf size (product of the sides).
CELL, STEP, LEAF = 65_536, 50_000, 64
_U = np.uint64


def shingle_hashes(text: bytes, k: int) -> list[int]:
    """XXH64 of every k-word shingle of the text (ASCII lower case)."""
    from xxhash import xxh64_intdigest as h
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [h(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [h(joined[s:e], SEED) for s, e in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())]


def fingerprints_of(texts: list[bytes], k: int) -> np.ndarray:
    """64-bit fingerprints (as uint64): a bit is 1 if set in over half the
    shingle hashes; 0 for a text without words."""
    hashes = [shingle_hashes(t, k) for t in texts]
    n = np.array([len(x) for x in hashes])
    out = np.zeros(len(texts), _U)
    full = np.flatnonzero(n)
    if len(full):
        flat = np.fromiter((x for h in hashes for x in h), _U, int(n.sum())).astype("<u8")
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.cumsum(n[full]) - n[full]
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        major = (2 * ones > n[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(major, axis=1, bitorder="little").reshape(-1).view("<u8")
    return out


def fingerprints(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) of every row; fp is the unsigned fingerprint's 64 bits as a
    long. Chunks bound the memory of a batch; a text is never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            fps = [fingerprints_of(texts[lo:hi], shingle) for lo, hi in chunks(texts, 1 << 20)]
            fp = np.concatenate(fps) if fps else np.zeros(0, _U)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(
        run, f"id {kind}, fp long")


def _bit(x: np.ndarray, lo: np.ndarray, d: int) -> np.ndarray:
    """First position at or after ``lo`` whose bit d (from the top) is set,
    in runs of ``x`` that share their first d bits."""
    top = x[lo] >> _U(64 - d) << _U(64 - d) if d else np.zeros(len(lo), _U)
    return np.searchsorted(x, top | _U(1 << (63 - d)))


def walk(a: np.ndarray, b: np.ndarray, budget: int) -> Forest:
    """Links of at most ``budget`` differing bits between sorted distinct
    fingerprints ``a`` and ``b`` (within ``a`` if ``b is a``), as a forest
    over positions of ``a`` and then of ``b``."""
    self_, shift = b is a, 0 if b is a else len(a)
    forest = Forest(len(a) + (0 if self_ else len(b)))
    one = lambda x: np.array([x], np.int64)
    stack = [(0, one(0), one(len(a)), one(0), one(len(b)), np.zeros(1, np.int8))] if len(a) and len(b) else []
    while stack:
        d, al, ah, bl, bh, cost = stack.pop()
        if len(al) > STEP:
            h = len(al) // 2
            stack += [(d, *(x[h:] for x in (al, ah, bl, bh, cost))), (d, *(x[:h] for x in (al, ah, bl, bh, cost)))]
            continue
        small = ((ah - al) * (bh - bl) <= LEAF) | (d == 64)
        if small.any():
            l, r, m = al[small], bl[small], (bh - bl)[small]
            size = (ah - al)[small] * m
            own = np.repeat(np.arange(len(l)), size)
            k = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
            i, j = l[own] + k // m[own], r[own] + k % m[own]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if self_:
                near &= i < j
            forest.join(i[near], j[near] + shift)
        go = ~small
        if not go.any():
            continue
        al, ah, bl, bh, cost = al[go], ah[go], bl[go], bh[go], cost[go]
        am = np.clip(_bit(a, al, d), al, ah)
        bm = np.clip(_bit(b, bl, d), bl, bh)
        twin = (al == bl) & self_
        parts = [(al, am, bl, bm, cost, None), (am, ah, bm, bh, cost, None),
                 (al, am, bm, bh, cost + 1, None), (am, ah, bl, bm, cost + 1, ~twin)]
        new = []
        for l, h, r, t, c, also in parts:
            ok = (l < h) & (r < t) & (c <= budget)
            new.append([x[ok if also is None else ok & also] for x in (l, h, r, t, c)])
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*new))))
        if not len(stack[-1][1]):
            stack.pop()
    return forest


def cells(fps: DataFrame, most: int) -> list[tuple[int, int]]:
    """(depth, prefix) of trie nodes that hold from 1 to ``most`` fingerprints
    and together all. Counts of 64 descendants a node come to the driver: a
    number of rows that is set by the cells, never by their pairs."""
    out: list[tuple[int, int]] = []
    total, open_, d = fps.count(), [0], 0
    if total <= most:
        return [(0, 0)]
    while open_:
        step = min(6, 64 - d)
        head = F.shiftrightunsigned("fp", 64 - d) if d else F.lit(0).cast("long")
        rows = (fps.where(head.isin(open_)).groupBy(F.shiftrightunsigned("fp", 64 - d - step).alias("p") if d + step < 64
                                                    else F.col("fp").alias("p")).count().collect())
        count = {r["p"] & (1 << d + step) - 1: r["count"] for r in rows}
        later = []

        def cut(prefix: int, depth: int) -> None:
            w = d + step - depth
            n = sum(count.get((prefix << w) + i, 0) for i in range(1 << w))
            if not n:
                return
            if n <= most and depth > d or depth == 64:
                out.append((depth, prefix))
            elif depth == d + step:
                later.append(prefix)
            else:
                cut(2 * prefix, depth + 1)
                cut(2 * prefix + 1, depth + 1)

        for p in open_:
            cut(p, d)
        open_, d = later, d + step
    return sorted(out, key=lambda x: x[1] << 64 - x[0])


def partners(i: int, depth: np.ndarray, lows: np.ndarray, budget: int) -> np.ndarray:
    """Cells j >= i whose common prefix bits differ from those of cell i in
    at most ``budget`` places: node pairs of the trie's top that survive."""
    w = np.minimum(depth[i], depth[i:])
    mask = np.where(w > 0, ~_U(0) << (64 - np.maximum(w, 1)).astype(_U), _U(0))
    return i + np.flatnonzero(np.bitwise_count((lows[i] ^ lows[i:]) & mask) <= budget)


def cell_pairs(spark: SparkSession, nodes: list[tuple[int, int]], budget: int) -> DataFrame:
    """(cell, pair, side): both cells of every pair that the budget allows,
    found by tasks that take some cells each; no list of pairs anywhere."""
    depth = np.array([d for d, _ in nodes])
    lows = np.array([p << 64 - d for d, p in nodes], _U)
    n = len(nodes)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                j = partners(i, depth, lows, budget)
                pair, other = i * n + j, j[j > i]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([np.full(len(j), i), other])), pa.array(np.concatenate([pair, pair[j > i]])),
                    pa.array(np.repeat(np.array([0, 1], np.int32), [len(j), len(other)]))], ["cell", "pair", "side"])

    tasks = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, n, 1, tasks).mapInArrow(find, "cell long, pair long, side int")


def cell_size(total: int, cores: int) -> int:
    """At most CELL fingerprints; fewer, down to 1,024, while the pairs of
    cells would leave cores idle. Classes never depend on it."""
    return min(CELL, max(1024, total // math.isqrt(8 * cores)))


def links(fps: DataFrame, budget: int, cell: int | None = None) -> DataFrame:
    """Spanning links (a, b) of all fingerprints (column fp, distinct) that
    differ in at most ``budget`` bits."""
    spark = fps.sparkSession
    cores = spark.sparkContext.defaultParallelism
    nodes = cells(fps, cell or cell_size(fps.count(), cores))
    lows = np.array([p << 64 - d for d, p in nodes], _U)
    n = len(nodes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.sort(b.column(0).to_numpy().view(_U))
            at = np.append(np.searchsorted(x, lows), len(x))
            held = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array([x[at[c]:at[c + 1]].tobytes() for c in held], pa.binary())],
                                             ["cell", "fps"])

    def join(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        blobs = t.column("fps").to_pylist()
        a, b = (np.sort(np.frombuffer(b"".join(x for x, s in zip(blobs, side) if s == w), _U)) for w in (0, 1))
        i, j = divmod(t.column("pair")[0].as_py(), n)
        x = a if i == j else np.concatenate([a, b])
        label = walk(a, a if i == j else b, budget).label
        out = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(x[out].view(np.int64)), "b": pa.array(x[label[out]].view(np.int64))})

    # sorted first, so that a batch holds long runs of few cells
    parts = fps.select("fp").repartitionByRange("fp").sortWithinPartitions("fp").mapInArrow(deal, "cell long, fps binary")
    dealt = parts.join(cell_pairs(spark, nodes, budget), "cell").select("pair", "side", "fps")
    # a stated number of partitions: few bytes a pair, but much work, so pairs must not be merged into few tasks
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores)
    return dealt.repartition(tasks, "pair").groupBy("pair").applyInArrow(join, "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = 4, budget: int = 4, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Near-duplicate classes: id, fingerprint (16 hex digits), component
    (smallest id reachable over links of at most ``budget`` bits).

    One row per input row, repeated rows included. A null or empty text
    has fingerprint zero, linked like any other; a text of fewer words
    than a shingle is one shingle. A null id never names a component
    unless all its ids are null. Other columns are not read; an empty
    table gives no rows.
    """
    rows = written(fingerprints(docs, shingle, id_col, text_col), "simhash-rows")
    fps = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-fps")
    root = components(links(fps, budget)).withColumnRenamed("node", "fp")
    classed = fps.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classed.groupBy("root").agg(F.min("first").alias("component"))
    classes = classed.join(least, "root").select("fp", "component")
    return rows.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component")


def keep_one(docs: DataFrame, shingle: int = 4, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the one with the
    smallest id (of equal ids, the first row of the written copy). Null
    ids come last. All columns pass unchanged."""
    row, = fresh(docs, "_row")
    base = written(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    found = simhash_components(base, shingle, budget, row, text_col)
    # rows are classed by their number; the class keeps the row with the least id
    named = base.select(F.col(row), F.col(id_col).alias("id")).join(found.select(row, "component"), row)
    best = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", row)).alias("m"))
    return base.join(best.select(F.col("m")[row].alias(row)), row, "left_semi").drop(row)
