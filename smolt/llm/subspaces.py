"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine c or more lie within squared distance T = 2 - 2c.
They are turned by one random rotation, which spreads every direction evenly,
and split into blocks of ``BLOCK_DIMS`` dimensions. The squared distance is
the sum over blocks, so two close vectors are close in at least one block:
within T times the block's share of the dimensions. Each block is range-joined
under that budget and the union of the pairs found is verified exactly, on the
vectors as given.

A block's range join deals vectors to grid cells of its first ``GRID_DIMS``
dimensions, twice as wide as the block's radius. A vector is at home in one
cell and visits those adjacent cells of smaller position that lie within the
radius, so a pair of a block meets in one cell. Cells of more than ``CELL``
vectors (a cluster of near copies, a hot label) are dealt to pairs of parts of
that size, each a task group of its own. A pair found in several blocks counts
in the first of them: block distances come from the rotated components as
stored (float32), term by term, so every task gets the same ones.

Equal vectors of a label are one class before the join and need no pairs. A
task returns, for each class it holds, how many vectors it links, and a
spanning forest of the links: never the pairs. Components come from the
forests, by alternating stars.

Rows whose vector is null, empty, all zero or holds null or non-finite
components, or whose label is null, link with nothing and stay. Vectors of
different lengths do not meet. Equal ids are separate rows; null ids come last
and stand for a component only if it has no other. An empty table gives no
row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smolt.llm.common import written
from smolt.llm.graph import Forest, components

#: Dimensions of a block and of its grid; vectors of a part of a cell; rows of a distance matrix.
BLOCK_DIMS, GRID_DIMS, CELL, SLICE = 8, 2, 4_000, 512
#: Widening of a block's budget: rounding of float32 components.
SLACK = 1e-5

_CELLS = pa.list_(pa.struct([("block", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("home", pa.bool_())]))


@lru_cache(4)
def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int, budget: float) -> list[tuple[slice, float]]:
    """Dimensions and squared-distance budget of every block."""
    cuts = [*range(0, dim, BLOCK_DIMS), dim]
    return [(slice(a, b), budget * (b - a) / dim + SLACK) for a, b in zip(cuts, cuts[1:])]


def cells(b: np.ndarray, budget: float) -> list[list[tuple]]:
    """For each rotated vector its (block, x, y, home) entries."""
    out: list[list[tuple]] = [[] for _ in b]
    for n, (dims, most) in enumerate(blocks(b.shape[1], budget)):
        radius = float(np.sqrt(most)) * (1 + 1e-9)
        grid = b[:, dims][:, :GRID_DIMS].astype(np.float64)
        if grid.shape[1] < GRID_DIMS:
            grid = np.pad(grid, ((0, 0), (0, GRID_DIMS - grid.shape[1])))
        at = np.floor(grid / (2 * radius)).astype(np.int64)
        rest = grid - at * (2 * radius)
        low, high = rest <= radius, rest >= radius
        for i, ((x, y), (lx, ly), (hx, hy)) in enumerate(zip(at.tolist(), low.tolist(), high.tolist())):
            own = out[i]
            own.append((n, x, y, True))
            # adjacent cells before this one in (x, y) order
            if ly:
                own.append((n, x, y - 1, False))
            if lx:
                own.append((n, x - 1, y, False))
                if ly:
                    own.append((n, x - 1, y - 1, False))
                if hy:
                    own.append((n, x - 1, y + 1, False))
    return out


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that squares stay finite."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def near(rotated: np.ndarray, i: np.ndarray, j: np.ndarray, dims: slice, most: float) -> np.ndarray:
    """Which pairs are within a block's budget; the same in every task."""
    s = np.zeros(len(i))
    for d in range(dims.start, dims.stop):
        gap = rotated[i, d].astype(np.float64) - rotated[j, d]
        s += gap * gap
    return s <= most


def cosines(v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = v[i] / np.abs(v[i]).max(axis=1, keepdims=True), v[j] / np.abs(v[j]).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def cell_links(v: np.ndarray, rotated: np.ndarray, home: np.ndarray, part: np.ndarray, unit_parts: tuple[int, int], block: int,
               least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of one cell (or pair of its parts), slice by slice."""
    every = blocks(v.shape[1], 2 - 2 * least)
    dims, most = every[block]
    x = rotated[:, dims].astype(np.float64)
    square = (x * x).sum(axis=1)
    a, b = (np.flatnonzero(part == p) for p in unit_parts)
    for s in range(0, len(a), SLICE):
        own = a[s:s + SLICE]
        d = square[own][:, None] + square[b][None, :] - 2 * (x[own] @ x[b].T)
        i, j = np.nonzero(d <= most + 1e-9)
        i, j = own[i], b[j]
        keep = home[i] | home[j]
        if unit_parts[0] == unit_parts[1]:
            keep &= i < j
        i, j = i[keep], j[keep]
        keep = near(rotated, i, j, dims, most)
        for before, its in every[:block]:
            keep[keep] = ~near(rotated, i[keep], j[keep], before, its)
        i, j = i[keep], j[keep]
        keep = cosines(v, i, j) >= least
        yield i[keep], j[keep]


def _classes(table: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows (row, id, key of their class or null), and the classes:
    p (their first row), id, copies, label, v (doubles as bytes)."""
    v = F.col(vec_col).cast("array<double>")
    fit = (F.col(label_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above
           & F.exists(v, lambda x: x != 0))
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                        F.when(F.coalesce(fit, F.lit(False)), v).alias("v"))
    rows = written(rows, "subspace-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("m")
    known = rows.where(F.col("v").isNotNull()).groupBy("label", "v").agg(first, F.count(F.lit(1)).alias("copies"))
    return rows, known.select(F.col("m.row").alias("p"), F.col("m.id").alias("id"), "copies", "label", "v")


def links(classes: DataFrame, least: float, cell: int = CELL) -> DataFrame:
    """(p, n, root) for every class p and task that found links of it: n
    vectors linked there, root a class that p is connected to there."""
    budget = 2 - 2 * least

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("dim").to_numpy()
            for dim in np.unique(size):
                part = b.filter(pa.array(size == dim))
                v = part.column("v").flatten().to_numpy().reshape(part.num_rows, dim)
                turned = (unit(v) @ rotation(dim)).astype(np.float32)
                found = [[dict(zip(("block", "x", "y", "home"), c)) for c in own] for own in cells(turned, budget)]
                raw = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("p"), part.column("copies"), part.column("label"), part.column("dim"), raw(v), raw(turned),
                     pa.array(found, _CELLS)], ["p", "copies", "label", "dim", "v", "b", "cells"])

    label = classes.schema["label"].dataType.simpleString()
    placed = classes.select("p", "copies", "label", F.size("v").alias("dim"), "v").mapInArrow(
        place, f"p long, copies long, label {label}, dim int, v binary, b binary, "
        "cells array<struct<block: int, x: long, y: long, home: boolean>>")
    placed = written(placed, "subspace-cells")
    where = ["label", "dim", "block", "x", "y"]
    sizes = placed.select("label", "dim", F.explode("cells").alias("c")).select("label", "dim", "c.*").groupBy(*where).agg(
        F.count(F.lit(1)).alias("held"), F.max("home").alias("lived")).where("held > 1 AND lived")
    sizes = sizes.select(*where, F.ceil(F.col("held") / cell).cast("int").alias("parts"))
    spread = placed.select("p", "copies", "label", "dim", "v", "b", F.explode("cells").alias("c")).select(
        "p", "copies", "label", "dim", "v", "b", "c.*").join(sizes, where)
    # a row of part i meets every part: units (min, max)
    spread = spread.withColumn("part", F.pmod(F.xxhash64("p"), F.col("parts")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).drop("other", "parts")

    def search(t: pa.Table) -> pa.Table:
        dim, block, lo, hi = (t.column(c)[0].as_py() for c in ("dim", "block", "lo", "hi"))
        read = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(t.num_rows, dim)
        v, turned = read("v", np.float64), read("b", np.float32)
        p, copies = t.column("p").to_numpy(), t.column("copies").to_numpy()
        forest, n = Forest(len(p)), np.zeros(len(p), np.int64)
        for i, j in cell_links(v, turned, t.column("home").to_numpy(zero_copy_only=False), t.column("part").to_numpy(), (lo, hi), block, least):
            n += np.bincount(i, copies[j], len(p)).astype(np.int64) + np.bincount(j, copies[i], len(p)).astype(np.int64)
            forest.join(i, j)
        some = np.flatnonzero(n)
        return pa.table([pa.array(p[some]), pa.array(n[some]), pa.array(p[forest.label[some]])], names=["p", "n", "root"])

    return written(spread.groupBy(*where, "lo", "hi").applyInArrow(search, "p long, n long, root long"), "subspace-links")


def near_duplicates(table: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    cell: int = CELL) -> DataFrame:
    """id, links (other rows linked directly) and component (smallest id
    reachable, itself included) of every row. Rows link if their labels are
    equal and the cosine of their vectors is ``least`` or more; ``least`` must
    be above 0."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    rows, classes = _classes(table, id_col, vec_col, label_col)
    classes = written(classes, "subspace-classes")
    found = links(classes, least, cell)
    linked = found.groupBy("p").agg(F.sum("n").alias("n"))
    roots = components(found.where("p <> root"), "p", "root")
    known = classes.join(linked, "p", "left").join(roots.withColumnRenamed("node", "p"), "p", "left").select(
        "label", "v", "id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "p").alias("root"))
    known = written(known, "subspace-known")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("m")
    component = known.groupBy("root").agg(first).select("root", F.col("m.id").alias("component"))
    known = known.join(component, "root").select("label", "v", "links", "component")
    out = rows.join(known, ["label", "v"], "left")
    return out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("links"),
                      F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))
