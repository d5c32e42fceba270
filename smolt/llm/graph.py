"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smolt.llm.common import written


class Forest:
    """Components of nodes 0..n-1 inside one task: label = smallest node."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.label[u], self.label[v]
            new = a != b
            u, v, a, b = u[new], v[new], a[new], b[new]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links`` that is not its component's
    smallest node (the root).

    Each round hangs every node's larger neighbours on its smallest one,
    then all of a node's smaller neighbours on the smallest; a long chain
    halves each round. Rounds are written to the shared folder. Smallest
    neighbours come from partial aggregates; only links move, so a node
    with very many links is a skewed join side that is split at run time.
    """
    u, v = F.col("u"), F.col("v")
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = written(edges, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.where(v > F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        edges = written(least.select("u", F.col("m").alias("v")).unionByName(small).distinct(), "links")
        # a star forest that two rounds leave alike is final
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(u.alias("node"), v.alias("root"))
        before = now
