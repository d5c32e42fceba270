import math
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

from smolt.llm import pieces as P
from llm_fixtures import odd, table  # noqa: F401

MODEL = path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return P.load(MODEL, 1.0)


def all_ways(p, unit):
    """Every segmentation of a unit with its weight."""
    if not unit:
        return {(): 1.0}
    out = {}
    for start, logp, ids in p.edges(unit, len(unit)):
        for head, w in all_ways(p, unit[:start]).items():
            out[head + ids] = w * math.exp(logp)
    return out


@pytest.mark.parametrize("unit", [" the", "cats", "日x"])
def test_samples_follow_the_lattice(model, unit):
    ways = all_ways(model, unit)
    n = 20_000
    got = Counter(tuple(x.tolist()) for x in P.sample_batch(model, [unit] * n, np.arange(n, dtype=np.uint64)))
    assert set(got) <= set(ways)
    whole = sum(ways.values())
    for way, w in ways.items():
        p = w / whole
        assert abs(got[way] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 5


def test_batch_equals_the_plain_sampler(model):
    """Unit by unit, in the log domain, with the same random numbers."""
    texts = ["Hello  wörld, it's\nfine. ", "日本語 テスト x", "a" * 100 + " b", "", "\n\n ▁ \t\x00é", "the cat " * 50, "😀" * 40 + " ok"]
    seeds = np.arange(7, dtype=np.uint64) * np.uint64(12345678901234567)
    for text, seed, got in zip(texts, seeds, P.sample_batch(model, texts, seeds)):
        want, at = [], 0
        import re
        for unit in re.findall(r"\n| *[^ \n]+| +", text):
            draw = lambda e, at=at, seed=seed: float(P.draws(np.array([seed]), np.array([at + e]))[0])
            want += [i for _, ids in reversed(model.sample(unit, draw)) for i in ids]
            at += len(unit)
        assert got.tolist() == want and b"".join(model.surface[i] for i in want).decode() == text


def test_round_trip_and_reproducibility(table, odd):
    docs = table(odd)
    once = P.encode(docs, MODEL)
    back = P.decode(once, MODEL)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    got = sorted(((r["doc_id"], r["text"], r["ids"]) for r in back.collect()), key=str)
    assert sorted(((i, t) for i, t, _ in got), key=str) == sorted(odd, key=str)
    again = P.decode(P.encode(docs.repartition(5), MODEL), MODEL)
    assert sorted(((r["doc_id"], r["text"], r["ids"]) for r in again.collect()), key=str) == got
    other = P.decode(P.encode(docs, MODEL, seed=1), MODEL).collect()
    assert sorted(map(key, other)) == sorted((i is None, i or 0, t or "") for i, t in odd)
    assert {bytes(r["ids"]) for r in other if r["ids"]} != {bytes(i) for _, _, i in got if i}
    assert P.encode(table([]), MODEL).collect() == []


def test_given_table(spark):
    from smolt.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op5_pieces"](spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and rows.where(~F.col("lossless")).count() == 0
