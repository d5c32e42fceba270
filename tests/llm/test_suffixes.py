import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from smolt.llm import suffixes as S
from smolt.llm.tokens import Words, bytes_of
from llm_fixtures import odd, table  # noqa: F401


def brute(rows, least):
    """All windows of all distinct (id, text) rows."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    seen = defaultdict(list)
    for k, (_, t) in enumerate(rows):
        w = (t or "").encode().split()
        for s in range(len(w) - least + 1):
            seen[tuple(w[s:s + least])].append((k, s))
    spans, cuts = defaultdict(set), defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for k, s in places:
                spans[k] |= set(range(s, s + least))
            if len({rows[k][0] for k, _ in places}) == len({k for k, _ in places}):  # no tie on the id
                for k, s in sorted(places)[1:]:
                    cuts[k] |= set(range(s, s + least))
    return {rows[k]: (spans[k], cuts[k]) for k in spans}


def words_of(spans):
    return {i for s in spans for i in range(s["start"], s["start"] + s["length"])}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    shared = [" ".join(rng.choices(vocab, k=rng.choice([8, 12, 15, 30]))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(vocab, k=rng.randrange(0, 40))) for _ in range(3)]
        for s in rng.sample(shared, rng.randrange(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), s)
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(parts)))
    return rows + [(n, rows[3][1]), (n + 1, "a b " * 40), (n + 2, None), (n + 3, ""), rows[5]]


def test_words():
    texts = [b"", b" a\tbb ", b"bb", None, "é ÀB".encode(), b"AB"]
    data, at = bytes_of(pa.array(texts, pa.binary()))
    w = Words(data, at, lower=True)
    assert [bytes(data[a:b]) for a, b in zip(w.start, w.end)] == [x for t in texts if t for x in t.split()]
    assert np.diff(w.row).tolist() == [len((t or b"").split()) for t in texts]
    assert w.hash[1] == w.hash[2] and len(set(w.hash.tolist())) == 5
    sliced = pa.array(texts, pa.binary()).slice(1, 2)
    assert bytes_of(sliced)[0].tobytes() == b" a\tbb bb"


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(table, seed):
    rows = corpus(seed)
    got = {}
    texts = {S_hash(t): t for _, t in rows}
    for r in S.passages(table(rows).repartition(7), least=12, window=6).collect():
        got[(r["id"], texts[r["h"]])] = (words_of(r["spans"]), words_of(r["cuts"]))
    assert got == brute(rows, 12)


def S_hash(text):
    import xxhash
    x = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def test_remove(table):
    rows = corpus(3)
    want = brute(rows, 12)
    out = S.remove_repeats(table(rows), least=12, window=6, chars_col="n_chars")
    assert out.columns == table(rows).columns
    got = [(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()]
    assert len(got) == len(rows)
    for i, t, n in got:
        old = next(x for k, x in rows if k == i)
        cut = want.get((i, old), (set(), set()))[1]
        assert (t is None) == (old is None) and (t or "").split() == [w for k, w in enumerate((old or "").split()) if k not in cut]
        assert n == (None if t is None else len(t))


def test_odd_documents(table, odd):
    got = {r["id"]: r for r in S.passages(table(odd)).collect()}
    assert set(got) == {6, 8} and words_of(got[6]["spans"]) == set(range(5000)) and words_of(got[6]["cuts"]) == set(range(1, 5000))
    assert S.passages(table([])).collect() == []
    copies = [(i, " ".join(f"x{k}" for k in range(60))) for i in (3, None, 2, 2)]
    assert {r["id"]: (words_of(r["spans"]) == set(range(60)), len(words_of(r["cuts"]))) for r in S.passages(table(copies)).collect()} == {
        2: (True, 0), 3: (True, 60), None: (True, 60)}


@pytest.mark.parametrize("batch", [1, 3, 4000])
def test_streams_agree_for_any_batch_and_task(spark, batch):
    """Hot keys over many tasks and batches, equal rows, null ids, and rows
    whose key agrees while the check does not."""
    rng = random.Random(batch)
    rows = [(rng.choice([1, 1, 1, 2, 3, k]), rng.randrange(2), rng.choice([None, 1, 2, k]), rng.randrange(3), rng.randrange(20)) for k in range(400)]
    rows += rows[:50]
    want = defaultdict(list)
    for key, check, i, h, p in set(rows):
        want[key, check].append((i is None, i or 0, h, p))
    want = sorted((null, i, h, p, k > 0) for v in want.values() if len(v) > 1 for k, (null, i, h, p) in enumerate(sorted(v)))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, str(batch))
    try:
        df = spark.createDataFrame(rows, "key long, check long, id long, h long, p int").repartition(5)
        got = S.agreeing(df).collect()
    finally:
        spark.conf.set(size, before)
    assert sorted((r["id"] is None, r["id"] or 0, r["h"], r["p"], r["earlier"]) for r in got) == want
