import math

import numpy as np
import pytest

from smolt.llm import subspaces


def brute(rows, least):
    """(id, vector, label) rows: (id, links, component), all pairs."""
    live = [v is not None and len(v) > 0 and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
            for _, v, label in rows]
    near = [set() for _ in rows]
    for i, (_, v, label) in enumerate(rows):
        for j in range(i):
            if live[i] and live[j] and rows[j][2] == label and len(rows[j][1]) == len(v):
                a, b = np.array(v, float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids, default=None)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["id"], r["links"], r["component"]) for r in df.collect()), key=str)


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, c, "z", 1) for i, v, c in rows], "vec_id long, embedding array<float>, label int, p string, row int")


@pytest.mark.parametrize("dim,cell", [(24, 4000), (20, 7), (5, 30), (1, 4000), (64, 25)])
def test_against_all_pairs(spark, dim, cell):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(260, dim))
    x[40:120] = x[rng.integers(0, 12, 80)] + rng.normal(size=(80, dim)) * rng.choice([0.05, 0.25, 0.35, 0.4], (80, 1))  # around the threshold
    x[120:180] = x[3] + 0.02 * rng.normal(size=(60, dim))  # one dense group
    x[180:200] = x[4] * np.array([1, 2.0, 1e-30, 1e30] * 5)[:, None]
    rows = [(int(i) * 3 % 257, [float(np.float32(v)) for v in r], int(i) % 2) for i, r in enumerate(x)]
    assert found(subspaces.near_duplicates(table_of(spark, rows), 0.93, cell=cell)) == brute(rows, 0.93)


def test_odd_vectors(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 0), (1, one, 0), (2, one, 1), (3, one, None), (4, None, 0), (5, [1.0, None, 3.0], 0), (6, [math.nan, 1.0, 1.0], 0),
            (7, [math.inf, 1.0, 1.0], 0), (8, [0.0, 0.0, 0.0], 0), (8, [0.0, 0.0, 0.0], 0), (9, [], 0), (None, [2.0, 4.0, 6.0], 0),
            (None, [9.0, 0.0, 0.0], 0), (None, [9.0, -0.0, 0.0], 0), (10, [1.0, 2.0], 0), (11, [2.0, 4.1], 0), (12, [3e38, 3e38, 0.0], 2), (-13, [1e-38, 1e-38, 0.0], 2)]
    assert found(subspaces.near_duplicates(table_of(spark, rows))) == brute(rows, 0.93)
    assert subspaces.near_duplicates(table_of(spark, [])).collect() == []
    with pytest.raises(ValueError):
        subspaces.near_duplicates(table_of(spark, []), 0.0)


def test_a_pair_counts_in_one_block_and_cell():
    rng = np.random.default_rng(1)
    x = subspaces.unit(np.repeat(rng.normal(size=(30, 32)), 6, axis=0) + rng.normal(size=(180, 32)) * 0.15)
    turned = (x @ subspaces.rotation(32)).astype(np.float32)
    where: dict = {}
    for i, own in enumerate(subspaces.cells(turned, 0.14)):
        for n, a, b, home in own:
            where.setdefault((n, a, b), []).append((i, home))
    pairs = []
    for (n, _, _), held in where.items():
        at = np.array([i for i, _ in held])
        for i, j in subspaces.cell_links(x[at], turned[at], np.array([h for _, h in held]), np.zeros(len(at), int), (0, 0), n, 0.93):
            pairs += [tuple(sorted(p)) for p in zip(at[i].tolist(), at[j].tolist())]
    cos = x @ x.T
    assert sorted(pairs) == sorted((i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if cos[i, j] >= 0.93)
