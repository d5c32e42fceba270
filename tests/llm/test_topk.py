import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from smolt.llm import topk


def brute(rows, is_query, k=10):
    """Every query against every row, in exact integers."""
    live = [(n, i, [math.floor(1024 * float(x)) for x in v]) for n, (i, v) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in live:
        if i is not None and is_query(i):
            s = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0, m) for m, j, v in live if m != n and len(v) == len(q))
            out += [(i, r + 1, None if null else j, -x) for r, (x, null, j, _) in enumerate(s[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=str)


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, row string")


@pytest.mark.parametrize("kind", ["clusters", "uniform", "copies"])
def test_against_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "ROWS_BLOCK", 150)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    if kind == "clusters":
        x = rng.normal(size=(5, 6))[rng.integers(0, 5, 400)] * 3 + 0.01 * x
    if kind == "copies":
        x[::3] = x[0]
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    assert found(topk.top_k(table_of(spark, rows), F.col("id") % 10 == 0)) == brute(rows, lambda i: i % 10 == 0)


def test_cells_out_of_reach_stay_away(spark, monkeypatch):
    """In separate clusters, rows meet the queries of few cells."""
    monkeypatch.setattr(topk, "ROWS_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 10)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 16))[rng.integers(0, 20, 1200)] * 4 + 0.02 * rng.normal(size=(1200, 16))
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    table = table_of(spark, rows)
    d = topk.deal(table, F.col("id") % 20 == 0)
    cells, per_query = d.cells.count(), [len(r["cells"]) for r in topk.surviving(d, 10).collect()]
    assert d.cells.agg(F.sum("parts")).first()[0] >= 30 and len(per_query) == 60
    assert sum(per_query) < 0.4 * cells * len(per_query)
    assert found(topk.top_k(table, F.col("id") % 20 == 0)) == brute(rows, lambda i: i % 20 == 0)


def test_lengths_that_the_sample_lacks(spark, monkeypatch):
    monkeypatch.setattr(topk, "SAMPLE", 1)
    rows = [(i, [float(i % 7), 1.0, 2.0][:1 + i % 3]) for i in range(60)]
    assert found(topk.top_k(table_of(spark, rows), F.col("id") % 10 == 0)) == brute(rows, lambda i: i % 10 == 0)


def test_odd_vectors(spark):
    one = [1.0, -0.5]
    rows = [(0, one), (100, one), (100, [0.25, 2.0]), (1, None), (2, [1.0, None]), (3, [math.nan, 1.0]), (4, [math.inf, 0.0]), (5, []),
            (6, [1.0]), (None, [3.0, 3.0]), (7, [-0.0001, 0.0]), (200, [1.0, 2.0, 3.0]), (8, [2.0 ** 20, 1.0])]
    assert found(topk.top_k(table_of(spark, rows), F.col("id") % 100 == 0)) == brute(rows, lambda i: i % 100 == 0)
    assert topk.top_k(table_of(spark, []), F.col("id") % 100 == 0).collect() == []


def test_large_components_are_exact():
    big = np.array([[2.0 ** 40, 3.0], [2.0 ** 40, 5.0], [2.0 ** 39, 7.0]])
    got = topk.dual_search(big, np.arange(3), big, np.arange(3), np.arange(3), 2)
    assert [(-s, i) for s, i, _ in got[0]] == [(2 ** 80 + 15, 1), (2 ** 79 + 21, 2)]


def test_tree_covers_and_prunes():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(8, 4))[rng.integers(0, 8, 1000)] * 50 + rng.normal(size=(1000, 4))

    def check(n):
        assert np.all(np.sqrt(((x[n.members] - n.centre) ** 2).sum(axis=1)) <= n.radius + 1e-9)
        if n.children:
            assert sorted(i for c in n.children for i in c.members) == sorted(n.members)
        for c in n.children:
            check(c)
    check(topk.tree_of(x))
