import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from smolt.llm import language as L
from llm_fixtures import odd, table  # noqa: F401


def brute_grams(text, n):
    t = text.lower()
    return [t[i:i + n] for i in range(len(t) - n + 1)]


def test_ngrams_stay_inside_rows():
    texts = ["", "a", "ab", "Abc", "", "héllo wörld 😀", "x"]
    for n, (idx, rows) in zip(L.ORDERS, L.ngrams(texts, 1 << 20)):
        assert np.diff(rows).tolist() == [len(brute_grams(t, n)) for t in texts] and len(idx) == rows[-1]
        alone = [next(i for k, (i, _) in zip(L.ORDERS, L.ngrams([t], 1 << 20)) if k == n).tolist() for t in texts]
        assert idx.tolist() == sum(alone, [])


def test_scores_match_naive_bayes():
    """Against the textbook sum over n-grams, on buckets without collisions."""
    model = np.log(np.random.default_rng(0).dirichlet(np.ones(4096), 3)).astype(np.float32)
    prior = np.log([0.5, 0.3, 0.2])
    for t in ("hello there", "Ça va?", ""):
        want = [p + sum(m[i] for idx, _ in L.ngrams([t], 4096) for i in idx) for p, m in zip(prior, model)]
        assert np.allclose(L.scores([t, "zz"], prior, model)[0], want, atol=1e-3)


def test_held_out_accuracy(spark):
    from smolt.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = [r for r in QUERIES["op3_language_id"](spark, sf).join(docs, "doc_id").collect() if r["held_out"]]
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def test_training_counts(table):
    rows = [(i, t) for i, t in enumerate(["abab", "ba", "ABC", "", None])]
    m = L.train(table(rows), F.lit(True), buckets=1 << 12, alpha=0.5)
    c = Counter(g for _, t in rows for n in L.ORDERS for g in brute_grams(t or "", n))
    total = sum(c.values()) + 0.5 * (1 << 12)
    top = max(c.values())
    assert m["langs"] == ["en"] and math.isclose(float(np.exp(m["matrix"].max())), (top + 0.5) / total, rel_tol=1e-4)


def test_odd_documents(table, odd):
    docs = table(odd)
    m = L.train(docs, F.lit(True))
    got = L.predict(docs, m).collect()
    assert len(got) == len(odd)
    for r in got:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (2, 3, 4, 8)) and 0 <= r["score"] <= 1
    nothing = L.train(table([]), F.lit(True))
    assert {r["lang_pred"] for r in L.predict(docs, nothing).collect()} == {"und"}
    assert L.predict(table([]), m).collect() == []


def test_number_signs_are_no_letters(table):
    texts = ["² ½ ①", "Ⅷ", "² x", "_ 12", "٣", "ª"]
    assert [L.has_letter(t) for t in texts] == [False, False, True, False, False, True]
    m = L.train(table([(1, "some words")]), F.lit(True))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(table(list(enumerate(texts))), m).collect()}
    assert got == {0: ("und", 0.0), 1: ("und", 0.0), 2: ("en", 1.0), 3: ("und", 0.0), 4: ("und", 0.0), 5: ("en", 1.0)}
