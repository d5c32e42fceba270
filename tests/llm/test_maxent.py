import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from smolt.llm import maxent as M
from llm_fixtures import odd, table  # noqa: F401


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def expected(rows, held):
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        ws = tokens(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        out.append((i is None, i or 0, len(ws), sum(c[w] > 0 for w in ws), n, round(base, 6)))
    return sorted(out)


def found(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                  for r in df.collect())


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


@pytest.fixture(scope="module")
def scored(spark):
    from smolt.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return [(r["doc_id"], r["text"]) for r in docs], QUERIES["op1_maxent"](spark, sf).cache()


def test_base_scores(scored):
    rows, got = scored
    assert found(got) == expected(rows, held)
    assert all(r["held_out"] == held(r["doc_id"]) for r in got.collect())


def test_model_beats_the_base_on_held_out_texts(scored):
    a, b = scored[1].where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert a > b * 0.98 and a < 0


def test_probabilities_sum_to_one(spark):
    """Over all tokens that a context can be followed by: head members, and
    each form class's words with one share for all unknown ones."""
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(1500)], 300)) for _ in range(20)]
    df = spark.createDataFrame([(t.encode(),) for t in texts], "text binary")
    counts = M.count_tokens(df)
    m, n = M.train(df, counts)
    c = {r["token"]: r["c"] for r in counts.collect()}
    assert n == 20 * 301 == sum(c.values())
    data = np.frombuffer(texts[0].encode(), np.uint8)
    t = M.read(data, np.array([0, len(data)]))
    sym, _ = m.symbols(t)
    row = M.context(sym, t)[5:6]
    p = np.exp(M.log_softmax(m.classes, row))[0]
    assert np.isclose(p.sum(), 1, atol=1e-4)
    assert np.isclose(np.exp(M.log_softmax(m.members, M.inner(np.array([3]), row))).sum(), 1, atol=1e-4)
    forms = {r["token"]: r["form"] for r in counts.collect()}
    head = set(m.head.view(np.int64).tolist())
    for k in range(M.FORM_CLASSES):
        inside = sum(c[w] + 1 for w in c if w not in head and forms[w] == k) + 1
        assert np.isclose(np.log10(inside), m.form_mass[k])


def test_context_stays_inside_texts():
    texts = [b"a b c", b"", b"a"]
    t = M.read(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert np.bincount(t.row).tolist() == [4, 1, 2] and (t.token == M.END).sum() == 3
    sym = np.arange(7)
    rows = M.context(sym, t)
    start = M.SYMBOLS - 1
    assert (rows[:, 1] - 1).tolist() == [start, 0, 1, 2, start, start, 5]
    assert (rows[:, 2] - 1 - M.SYMBOLS).tolist() == [start, start, 0, 1, start, start, start]


def test_odd_documents(table, odd):
    got = M.score(table(odd), ~M.fold(F.col("doc_id")))
    assert found(got) == expected(odd, held)
    none = M.score(table(odd), F.lit(False)).collect()
    assert len(none) == len(odd) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in none)
    assert M.score(table([]), F.lit(True)).collect() == []
