import numpy as np
import pytest
from xxhash import xxh64_intdigest

from smolt.llm import simhash
from llm_fixtures import odd, table  # noqa: F401


def fingerprint(text, k):
    """The contract, word by word."""
    words = (text or "").encode().lower().split()
    shingles = [words[i:i + k] for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, budget):
    """Component (smallest position) of each fingerprint, over all pairs."""
    label = list(range(len(fps)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def expected(rows, k=4, budget=4):
    fps = [fingerprint(t, k) for _, t in rows]
    own = classes(fps, budget)
    least = {}
    for (i, _), c in zip(rows, own):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted((i is None, i or 0, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(rows, fps, own))


def found(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component"]) for r in df.collect())


def test_odd_documents(table, odd):
    assert found(simhash.simhash_components(table(odd))) == expected(odd)
    assert simhash.simhash_components(table([])).collect() == []


@pytest.mark.parametrize("cell", [7, 1000])
def test_given_table(spark, monkeypatch, cell):
    from smolt.session import ship_package
    ship_package(spark)
    monkeypatch.setattr(simhash.links, "__defaults__", (cell,))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(simhash.simhash_components(docs, budget=8)) == expected(rows, budget=8)


def test_keep_one(table, odd):
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in simhash.keep_one(table(odd)).collect())
    reps = {c for *_, c in expected(odd)} - {None}
    assert [i for null, i in kept if not null] == sorted(reps)
    copies = [(i, "one two three four five six seven") for i in (9, 4, 4)] + [(None, "a lone text without an id here")]
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(table(copies)).collect()) == ["4", "None"]


def test_walk_against_all_pairs():
    rng = np.random.default_rng(1)
    for n in (1, 5, 700):
        x = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        for i in range(n // 3):
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                x[n - 1 - i] = x[i] ^ np.uint64(1 << int(b))
        x = np.unique(x)
        assert simhash.walk(x, x, 4).label.tolist() == classes([int(v) for v in x], 4)


@pytest.mark.parametrize("cell", [1, 20])
def test_thousands_of_cells(spark, cell):
    """Pairs of cells are found in tasks: same classes as over all pairs."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2)
    for i in range(600):
        for b in rng.integers(0, 64, rng.integers(1, 7)):
            x[1999 - i] = x[1999 - i] if b == 63 else x[i] ^ np.uint64(1 << int(b))
    x = np.unique(x)
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    nodes = simhash.cells(fps, cell)
    assert len(nodes) == len(x) if cell == 1 else len(nodes) > 100
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(fps, 4, cell)).collect()}
    own = [int(v) for v in x.view(np.int64)]
    groups, want = {}, {}
    for v, c in zip(own, classes([int(v) for v in x], 4)):
        groups.setdefault(found.get(v, v), set()).add(v)
        want.setdefault(c, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_cell_size_uses_idle_cores():
    assert simhash.cell_size(10, 6) == 1024
    assert simhash.cell_size(60_000, 6) == 10_000
    assert simhash.cell_size(10**9, 6000) == simhash.CELL
