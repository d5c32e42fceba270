"""Exact top-k inner-product search with dual cover trees over the table.

A top cover tree over a bounded sample gives the cells; every row is dealt to
its nearest cell and moves there, queries to groups of the same kind. A query
first meets a part of its own cell, which gives it a kth score to beat. With
that score it drops every cell whose centre and covering radius rule it out,
before any row is exchanged; only the pairs of query group and cell that
survive meet. A cell of many rows and a group of many queries are split into
parts of bounded size. In a meeting both sides are indexed as cover trees: a
node has a centre and a covering radius, its children cover it at a smaller
radius and their centres lie farther apart than that. Pairs of a query node
and a row node are walked together, best bound first; a pair is dropped when
no inner product below it, bounded by the two centres and radii, can reach
the worst kth score of the node's queries. The results of the meetings are
merged by one ranked window of k rows per query and meeting.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smolt.llm.common import written

SCALE = 1024.0
#: Sampled rows, their bytes, and the cells of the top tree, at most; sampled rows a cell.
SAMPLE, SAMPLE_BYTES, CELLS, PER_CELL = 4_096, 32 << 20, 1_024, 8
#: Partitions of a meeting, at most: each takes its units one after the other.
MEETINGS = 20_000
#: Rows and queries of a unit; rows of a leaf; shrinking of the radius from node to child.
ROWS_BLOCK, QUERY_BLOCK, LEAF, SHRINK = 2_048, 1_024, 64, 1.5
#: Integers below this are exact as doubles.
EXACT = float(1 << 53)


class Node:
    __slots__ = ("children", "centre", "members", "norm", "radius")

    def __init__(self, centre: np.ndarray, radius: float, members: np.ndarray, children: list):
        self.centre, self.radius, self.members, self.children = centre, radius, members, children
        self.norm = float(np.sqrt(centre @ centre))


class Points:
    """Vectors with their squared norms: distances take one product."""

    def __init__(self, x: np.ndarray):
        self.x, self.square = x, (x * x).sum(axis=1)
        # rounding of very long vectors: radii are widened by this much
        self.slack = 1e-7 * float(np.sqrt(self.square.max(initial=0.0)))

    def distances(self, members: np.ndarray, centre: int) -> np.ndarray:
        d = self.square[members] + self.square[centre] - 2 * (self.x[members] @ self.x[centre])
        return np.sqrt(np.maximum(d, 0.0))


def cover_tree(p: Points, members: np.ndarray, first: int, dist: np.ndarray, size: int = LEAF) -> Node:
    """The tree over ``members`` with centre ``first`` and leaves of ``size``
    members; ``dist`` are the members' distances from the centre."""
    far = float(dist.max(initial=0.0))
    if len(members) <= size or far == 0.0:
        return Node(p.x[first], far + p.slack, members, [])
    reach, children, single = far / SHRINK, [], []
    centre, left, d = first, members, dist
    while True:
        near = d <= reach
        own = left[near]
        if len(own) == 1:
            single.append(int(own[0]))
        else:
            children.append(cover_tree(p, own, centre, d[near], size))
        left = left[~near]
        if not len(left):
            break
        centre = int(left[0])
        d = p.distances(left, centre)
    for i in range(0, len(single), size):  # children without children share leaves
        part = np.array(single[i:i + size])
        children.append(Node(p.x[part[0]], float(p.distances(part, int(part[0])).max()) + p.slack, part, []))
    return Node(p.x[first], far + p.slack, members, children)


def tree_of(x: np.ndarray, size: int = LEAF) -> Node:
    p, every = Points(x), np.arange(len(x))
    return cover_tree(p, every, 0, p.distances(every, 0), size)


def top_centres(x: np.ndarray, n: int) -> np.ndarray:
    """Centres of at most ``n`` nodes that cover ``x``: the widest node gives
    way to its children until there are enough; of more, the fullest stay."""
    root = tree_of(x, 1)
    open_, done = [(-root.radius, 0, root)], []
    made = 1
    while open_ and len(open_) + len(done) < n:
        node = heapq.heappop(open_)[2]
        if not node.children:
            done.append(node)
        for c in node.children:
            heapq.heappush(open_, (-c.radius, made, c))
            made += 1
    nodes = done + [node for _, _, node in sorted(open_, key=lambda o: o[1])]
    return np.array([node.centre for node in sorted(nodes, key=lambda node: -len(node.members))[:n]])


def _exact_products(a: list, b: list) -> np.ndarray:
    """Inner products too large for doubles, as Python integers."""
    return np.array([[sum(p * q for p, q in zip(u, v)) for v in b] for u in a], object).reshape(len(a), len(b))


def dual_search(q: np.ndarray, q_row: np.ndarray, x: np.ndarray, x_row: np.ndarray, x_id: np.ndarray, k: int,
                floor: np.ndarray | None = None) -> list[list[tuple]]:
    """For each query the k best (score, -, row) of ``x`` but itself, as
    sorted lists of (-score, id, row). ``x_id`` must order as ids do. Scores
    below a query's ``floor`` may be left out."""
    best: list[list[tuple]] = [[] for _ in q]
    worst = np.full(len(q), -np.inf) if floor is None else floor.copy()
    size = max(float(np.abs(q).max(initial=0)), float(np.abs(x).max(initial=0)))
    exact = size * size * max(1, q.shape[1]) < EXACT

    def leaf(a: Node, b: Node) -> None:
        s = q[a.members] @ x[b.members].T if exact else _exact_products(
            [[int(v) for v in r] for r in q[a.members]], [[int(v) for v in r] for r in x[b.members]])
        able = np.flatnonzero(s.max(axis=1) >= worst[a.members]) if exact else np.arange(len(s))
        for i, row in zip(a.members[able], s[able]):
            # a tie with the kth stays: the smaller id wins it
            hit = np.flatnonzero(row >= worst[i]) if exact else np.arange(len(row))
            if exact and len(hit) > 4 * k:
                hit = hit[row[hit] >= np.partition(row[hit], -(k + 1))[-(k + 1)]]
            mine = best[i] + [(-int(row[j]), x_id[b.members[j]], x_row[b.members[j]]) for j in hit if x_row[b.members[j]] != q_row[i]]
            mine.sort()
            best[i] = mine[:k]
            if len(mine) >= k:
                worst[i] = max(worst[i], -best[i][-1][0])

    def bound(a: Node, b: Node) -> float:
        top = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return top + 1e-9 * abs(top) + 1e-6

    stack = [(tree_of(q), tree_of(x))] if len(q) and len(x) else []
    while stack:
        a, b = stack.pop()
        if bound(a, b) < worst[a.members].min():
            continue
        if not a.children and not b.children:
            leaf(a, b)
        elif a.children and (not b.children or a.radius > b.radius):
            stack += sorted(((c, b) for c in a.children), key=lambda p: bound(*p))
        else:
            stack += sorted(((a, c) for c in b.children), key=lambda p: bound(*p))
    return best


#: First cell number and centres of each dimension.
Cover = dict[int, tuple[int, np.ndarray]]


def cover_of(sample: list[np.ndarray], n: int) -> Cover:
    """About ``n`` cells, shared among the dimensions by their sampled rows."""
    by_dim: dict[int, list] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    out, first = {}, 0
    for dim, vs in sorted(by_dim.items()):
        centres = top_centres(np.array(vs).reshape(len(vs), dim), max(1, n * len(vs) // len(sample)))
        out[dim] = (first, centres)
        first += len(centres)
    return out


def nearest(x: np.ndarray, cover: Cover) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row of ``x`` and the distance from its centre. A
    dimension that the sample lacks is one cell around zero, of a number
    below zero."""
    first, c = cover.get(x.shape[1], (-1 - x.shape[1], np.zeros((1, x.shape[1]))))
    with np.errstate(all="ignore"):
        at = ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
        return first + at, np.sqrt(((x - c[at]) ** 2).sum(axis=1))


def _floored(v: list | None) -> np.ndarray | None:
    """The scaled components; None for a vector that takes no part."""
    if v is None or None in v:
        return None
    a = np.array(v, np.float64)
    return np.floor(SCALE * a) if np.isfinite(a).all() else None


class Dealt(NamedTuple):
    """Rows with their cells, cells with their parts and radii, queries with
    their groups, and the centres of the cells."""
    rows: DataFrame
    cells: DataFrame
    queries: DataFrame
    cover: Cover


def deal(table: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding") -> Dealt:
    """Index ``table``: rows that take part, written once with their cells,
    so that row numbers are fixed. The sample (at most ``SAMPLE`` rows and
    ``SAMPLE_BYTES``) sets the centres only, every row is indexed."""
    base = (table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                         F.col(vec_col).cast("array<double>").alias("v"))
            .withColumn("asks", F.coalesce(is_query, F.lit(False))))
    n_rows, n_queries, wide = base.agg(F.count("v"), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    bound = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, wide))))
    wanted = max(1, min(CELLS, bound, -(-n_rows // ROWS_BLOCK)))
    sampled = base.where("v IS NOT NULL").orderBy(F.xxhash64("id", "v")).limit(min(bound, PER_CELL * wanted)).select("v").collect()
    sample = [a for a in (_floored(r["v"]) for r in sampled) if a is not None]
    cover, coarse = cover_of(sample, wanted), cover_of(sample, max(1, min(wanted, -(-n_queries // QUERY_BLOCK))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of: dict[int, list] = {}
            for i, v in enumerate(b.column("v").to_pylist()):
                a = _floored(v)
                if a is not None:
                    of.setdefault(len(a), []).append((i, a))
            for dim, some in of.items():
                at = pa.array([i for i, _ in some], pa.int64())
                x = np.array([a for _, a in some]).reshape(len(some), dim)
                cell, far = nearest(x, cover)
                yield pa.RecordBatch.from_arrays(
                    [b.column("row").take(at), b.column("id").take(at), b.column("asks").take(at), pa.array([dim] * len(some), pa.int32()),
                     pa.array([a.tobytes() for a in x], pa.binary()), pa.array(cell, pa.int32()), pa.array(far),
                     pa.array(nearest(x, coarse)[0], pa.int32())],
                    ["row", "id", "asks", "dim", "v", "cell", "far", "grp"])

    rows = written(base.mapInArrow(run, "row long, id long, asks boolean, dim int, v binary, cell int, far double, grp int"), "topk-vectors")
    parts = lambda n: F.ceil(F.count("*") / F.lit(n)).cast("int")
    cells = written(rows.groupBy("cell").agg(parts(ROWS_BLOCK).alias("parts"), F.max("far").alias("radius")), "topk-cells")
    groups = rows.where("asks").groupBy("grp").agg(parts(QUERY_BLOCK).alias("blocks"))
    queries = (rows.where("asks").join(groups, "grp").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
               .select("row", "id", "dim", "v", "cell", "grp", "block"))
    placed = (rows.join(cells.select("cell", "parts"), "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
              .select("row", "id", "dim", "v", "cell", "part"))
    return Dealt(placed, cells, queries, cover)


UNIT = ["grp", "block", "cell", "part"]


def meet(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query in each of its units: queries carry
    ``floor`` and a row per unit; rows go to the units that some query of the
    group wants."""
    units = queries.select(*UNIT).distinct()
    n = max(1, min(MEETINGS, units.count()))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        def matrix(t):
            return np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(t.num_rows, -1 if dim else 0)
        out = []
        if a.num_rows and b.num_rows:
            dim = a.column("dim")[0].as_py()
            q_row, x_row = a.column("row").to_numpy(), b.column("row").to_numpy()
            q_id, x_id = a.column("id").to_pylist(), b.column("id").to_pylist()
            order = np.array([np.iinfo(np.int64).max if i is None else i for i in x_id], np.int64)
            floor = np.array([-np.inf if f is None else float(f) for f in a.column("floor").to_pylist()])
            names = dict(zip(x_row.tolist(), x_id))
            for i, found in enumerate(dual_search(matrix(a), q_row, matrix(b), x_row, order, k, floor)):
                out += [(int(q_row[i]), q_id[i], names[int(r)], int(r), -s) for s, _, r in found]
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query", "query_id", "id", "row", "score"])

    left = queries.select(*UNIT, "row", "id", "dim", "v", "floor").repartition(n, *UNIT)
    right = rows.join(units, ["cell", "part"]).select(*(F.col(c).alias(c) for c in (*UNIT, "row", "id", "dim", "v"))).repartition(n, *UNIT)
    return left.groupBy(*UNIT).cogroup(right.groupBy(*UNIT)).applyInArrow(
        search, "query long, query_id long, id long, row long, score long")


def surviving(d: Dealt, k: int) -> DataFrame:
    """Queries with the kth score of a part of their own cell (``floor``,
    null if that holds fewer rows) and the cells that can reach it. Written,
    as the units are taken from it twice."""
    first = meet(d.queries.withColumn("part", F.lit(0).cast("long")).withColumn("floor", F.lit(None).cast("long")), d.rows, k)
    floors = first.groupBy(F.col("query").alias("row")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    radius = {r["cell"]: r["radius"] for r in d.cells.where("cell >= 0").collect()}  # at most CELLS rows
    cover = d.cover

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = []
            for dim, cell, v, floor in zip(*(b.column(c).to_pylist() for c in ("dim", "cell", "v", "floor"))):
                if cell < 0 or floor is None:
                    first, centres = cover.get(dim, (cell, [0]))
                    lists.append([c for c in range(first, first + len(centres)) if c < 0 or c in radius])
                    continue
                first, centres = cover[dim]
                live = [c for c in range(len(centres)) if first + c in radius]
                q, r = np.frombuffer(v, np.float64), np.array([radius[first + c] for c in live])
                with np.errstate(all="ignore"):
                    size, c = np.sqrt(q @ q), centres[live]
                    top = c @ q + size * r
                    top += 1e-9 * size * (np.sqrt((c * c).sum(axis=1)) + r) + 1e-6
                    lists.append([first + live[j] for j in np.flatnonzero(~(top < float(floor)))])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(lists, pa.list_(pa.int32()))], [*kept, "cells"])

    kept = ["row", "id", "dim", "v", "grp", "block", "floor"]
    seeded = d.queries.join(floors, "row", "left")
    return written(seeded.mapInArrow(run, "row long, id long, dim int, v binary, grp int, block long, floor long, cells array<int>"),
                   "topk-queries")


def top_k(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k highest inner products of each query row: query_id, rank (from
    1), id, score; ties go to the smaller id (null ids last).

    Components x count as floor(1024 * x). Vectors that are null or hold
    null or non-finite components take no part; vectors of different
    lengths do not meet. ``is_query`` is a condition on the id. A row is no
    candidate for itself; rows of equal id or vector are separate rows.
    Scores must fit a long. Fewer than k candidates give fewer rows; an
    empty table gives none; other columns are not read.
    """
    d = deal(table, is_query, id_col, vec_col)
    wants = surviving(d, k).withColumn("cell", F.explode("cells")).join(d.cells.select("cell", "parts"), "cell")
    found = meet(wants.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))), d.rows, k)
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return (found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
