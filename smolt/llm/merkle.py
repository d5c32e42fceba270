"""Merkle manifest of a dataset, with proofs and folding from hash midstates.

Every row is a leaf. The leaves of a group are numbered in key order; every
``fanout`` consecutive nodes (the last run may hold fewer, even one) hash to
their parent until one node is left, the group's subroot. The subroots, in
group order, likewise hash to the root. A digest enters its parent's hash as
lower-case hex text.

Spark builds the tree in rounds: one range exchange numbers the leaves, then
aligned blocks of ``fanout ** levels`` consecutive nodes, in one task each,
become one node of the next round, so a group of any size is spread over its
blocks. The way down joins each block with the path above it, round by round.

While a task hashes a parent it retains a copy of the hash state before each
child slot. To fold a replaced leaf, the state before its slot is resumed and
takes the replacement and the siblings to its right; those to its left are
never hashed again. States above a block are made once for the block.

Null keys come first, a null group first among the groups, rows of equal key
in the order of their leaves; repeated rows are leaves of their own. Empty and
very long texts are hashed like any other (in the JVM, never moved). An empty
table has no leaf and gives no row. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smolt.llm.common import written

#: Levels that one task hashes; children of a node.
LEVELS, FANOUT = 10, 2

_PATH = "left array<binary>, right array<binary>, subroot binary, root binary"
_NODE = "g string, pos long, total long, digest binary"


def field(c: Column) -> Column:
    """``-`` for a null, else the UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(*cols: Column) -> Column:
    """Digest (binary) of a row's fields."""
    return F.unhex(F.sha2(F.concat(*map(field, cols)), 256))


class Subtree:
    """Nodes of consecutive leaves, level by level, and for every child the
    copied state of its parent's hash before it."""

    def __init__(self, digests: Sequence[bytes], levels: int, fanout: int = FANOUT):
        self.fanout, self.rows, self.states = fanout, [[d.hex().encode() for d in digests]], []
        for _ in range(levels):
            row, kept, up = self.rows[-1], [], []
            for i in range(0, len(row), fanout):
                h = hashlib.sha256()
                for d in row[i:i + fanout]:
                    kept.append(h.copy())
                    h.update(d)
                up.append(h.hexdigest().encode())
            self.states.append(kept)
            self.rows.append(up)

    def siblings(self, i: int) -> list[tuple[bytes, bytes]]:
        """Hex digests left and right of leaf ``i`` and of each node above it."""
        out = []
        for row in self.rows[:len(self.states)]:
            run = i - i % self.fanout
            out.append((b"".join(row[run:i]), b"".join(row[i + 1:run + self.fanout])))
            i //= self.fanout
        return out

    def fold(self, i: int, replacement: bytes) -> bytes:
        """Hex digest of the top when leaf ``i`` is replaced (hex digest)."""
        for row, states in zip(self.rows, self.states):
            h = states[i].copy()
            h.update(replacement)
            for d in row[i + 1:i - i % self.fanout + self.fanout]:
                h.update(d)
            replacement = h.hexdigest().encode()
            i //= self.fanout
        return replacement


def height(total: int, fanout: int) -> int:
    """Levels from ``total`` leaves to one node."""
    n = 0
    while total > 1:
        total, n = -(-total // fanout), n + 1
    return n


def _subtree(block: pa.Table, fanout: int, levels: int) -> tuple[pa.Table, Subtree]:
    block = block.sort_by("pos")
    levels = min(levels, height(block.column("total")[0].as_py(), fanout))
    return block, Subtree(block.column("digest").to_pylist(), levels, fanout)


def numbered(nodes: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``nodes`` with their position in their group ``g`` and the group's
    size, from one written copy of the range-sorted rows."""
    keys = ["g", *order, "tie"]
    placed = (nodes.withColumn("tie", F.monotonically_increasing_id())  # splits runs of equal rows
              .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
              .withColumn("at", F.monotonically_increasing_id()))
    rows = written(placed, name).withColumn("task", F.shiftright("at", 33))
    before = Window.partitionBy("g").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("g", "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))  # a row per task and group
    runs = runs.select("g", "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                       F.sum("n").over(Window.partitionBy("g")).alias("total"))
    return rows.join(runs, ["g", "task"]).withColumn("pos", F.col("at") + F.col("shift")).drop("task", "at", "shift")


def climb(nodes: DataFrame, fanout: int, levels: int, name: str) -> list[DataFrame]:
    """The nodes of every round: leaves first, one node for each group last."""
    width = fanout ** levels

    def top(block: pa.Table) -> pa.Table:
        block, tree = _subtree(block, fanout, levels)
        total = block.column("total")[0].as_py()
        return pa.table({"g": [block.column("g")[0].as_py()], "pos": [block.column("pos")[0].as_py() // width],
                         "total": [-(-total // width)], "digest": [bytes.fromhex(tree.rows[-1][0].decode())]},
                        schema=pa.schema([("g", pa.string()), ("pos", pa.int64()), ("total", pa.int64()), ("digest", pa.binary())]))

    rounds, most = [nodes], nodes.agg(F.max("total")).first()[0] or 1
    while most > 1:
        blocks = rounds[-1].select("g", "pos", "total", "digest", F.floor(F.col("pos") / width).alias("block"))
        rounds.append(written(blocks.groupBy("g", "block").applyInArrow(top, _NODE), name))
        most = -(-most // width)
    return rounds


def _blocks(nodes: DataFrame, above: DataFrame, width: int):
    block = F.floor(F.col("pos") / width).alias("block")
    return nodes.select("*", block).groupBy("g", "block").cogroup(
        above.withColumnRenamed("pos", "block").groupBy("g", "block"))


def paths(nodes: DataFrame, above: DataFrame, fanout: int, levels: int, name: str) -> DataFrame:
    """Siblings on the way from every node up to the root, given those of
    the blocks they are in."""

    def run(block: pa.Table, up: pa.Table) -> pa.Table:
        block, tree = _subtree(block, fanout, levels)
        up = up.to_pylist()[0]
        own = [tree.siblings(i) for i in range(block.num_rows)]
        side = lambda k: [[bytes.fromhex(s[k].decode()) for s in x] + up[("left", "right")[k]] for x in own]
        n = block.num_rows
        return pa.table({"g": block.column("g"), "pos": block.column("pos"), "left": pa.array(side(0), pa.list_(pa.binary())),
                         "right": pa.array(side(1), pa.list_(pa.binary())), "subroot": pa.array([up["subroot"]] * n, pa.binary()),
                         "root": pa.array([up["root"]] * n, pa.binary())})

    return written(_blocks(nodes, above, fanout ** levels).applyInArrow(run, f"g string, pos long, {_PATH}"), name)


def proofs(leaves: DataFrame, above: DataFrame, fanout: int, levels: int, carry: Sequence[tuple[str, str]]) -> DataFrame:
    """One row for each leaf: its siblings from the leaf to the root, and the
    root folded from its replacement (from itself where that is null)."""

    def run(block: pa.Table, up: pa.Table) -> pa.Table:
        block, tree = _subtree(block, fanout, levels)
        up = up.to_pylist()[0]
        hexed = lambda b: b.hex().encode()
        # the states before this block's slot, level by level above it
        resume = [(hashlib.sha256(hexed(a)), hexed(b)) for a, b in zip(up["left"], up["right"])]
        rest = b"".join(a + b for a, b in zip(up["left"], up["right"]))
        siblings, folded = [], []
        for i, (own, new) in enumerate(zip(block.column("digest").to_pylist(), block.column("replacement").to_pylist())):
            siblings.append(bytes.fromhex(b"".join(a + b for a, b in tree.siblings(i)).decode()) + rest)
            top = tree.fold(i, hexed(own if new is None else new))
            for state, right in resume:
                h = state.copy()
                h.update(top)
                h.update(right)
                top = h.hexdigest().encode()
            folded.append(bytes.fromhex(top.decode()))
        n = block.num_rows
        more = {"leaf": block.column("digest"), "subroot": pa.array([up["subroot"]] * n, pa.binary()),
                "root": pa.array([up["root"]] * n, pa.binary()), "siblings": pa.array(siblings, pa.binary()),
                "folded": pa.array(folded, pa.binary())}
        return pa.table({**{c: block.column(c) for c, _ in carry}, **more})

    kinds = "".join(f"`{c}` {kind}, " for c, kind in carry)
    return _blocks(leaves, above, fanout ** levels).applyInArrow(run, kinds + "leaf binary, subroot binary, root binary, siblings binary, folded binary")


def manifest(table: DataFrame, digest: Column, group: Column, key: Column, replacement: Column | None = None,
             fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """key, leaf, subroot, root, siblings and folded (digests as binary;
    siblings concatenated from the leaf up, left to right) for every row.

    ``digest`` is a row's leaf, ``replacement`` another leaf to fold in its
    place (null: its own). ``group`` is compared as text. See the module for
    nulls, ties, repeated rows and empty tables.
    """
    g = F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group.cast("string")))
    new = F.lit(None).cast("binary") if replacement is None else replacement
    leaves = table.select(g.alias("g"), key.alias("key"), digest.alias("digest"), new.alias("replacement"))
    leaves = numbered(leaves, ["key", "digest"], "merkle-leaves")
    rounds = climb(leaves, fanout, levels, "merkle-nodes")
    tops = rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("key"), "digest")
    tops = numbered(tops, ["key"], "merkle-subroots")
    upper = climb(tops, fanout, levels, "merkle-top")
    none = F.array().cast("array<binary>")
    way = upper[-1].select("g", "pos", none.alias("left"), none.alias("right"), F.lit(None).cast("binary").alias("subroot"),
                           F.col("digest").alias("root"))
    for nodes in reversed(upper[:-1]):
        way = paths(nodes.select("g", "pos", "total", "digest"), way, fanout, levels, "merkle-paths")
    # the path of a subroot is that of its group's one node in the last round
    way = tops.join(way, ["g", "pos"]).select(F.col("key").alias("g"), F.lit(0).cast("long").alias("pos"), "left", "right",
                                              F.col("digest").alias("subroot"), "root")
    for nodes in reversed(rounds[1:-1]):
        way = paths(nodes, way, fanout, levels, "merkle-paths")
    return proofs(leaves, way, fanout, levels, [("key", leaves.schema["key"].dataType.simpleString())])
