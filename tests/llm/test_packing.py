import zlib

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

from smolt.llm import packing
from llm_fixtures import odd, table  # noqa: F401

VOCAB = path("word_bpe_49k.json")


def whole(texts):
    from tokenizers import Tokenizer
    got = Tokenizer.from_file(VOCAB).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array([*e.ids, packing.END_ID], "<u4") for e in got]


def check(rows, docs, window):
    """Every id of every document lies in one piece; sequences are gapless and full but the last."""
    want = sorted((i is None, i or 0, x.tobytes()) for (i, _), x in zip(docs, whole([t for _, t in docs])))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        key = (r["sequence_id"] * window + r["offset"] - r["start"])
        by_doc.setdefault(key, []).append(r)
    got = []
    for parts in by_doc.values():
        parts.sort(key=lambda r: r["start"])
        ids = b"".join(r["ids"] for r in parts)
        assert [r["start"] for r in parts] == list(np.cumsum([0] + [r["length"] for r in parts[:-1]]))
        assert {r["doc_tokens"] for r in parts} == {len(ids) // 4}
        got.append((parts[0]["doc_id"] is None, parts[0]["doc_id"] or 0, ids))
    assert sorted(got) == want
    for k, s in by_seq.items():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == list(np.cumsum([0] + [r["length"] for r in s[:-1]]))
        assert k == len(by_seq) - 1 or sum(r["length"] for r in s) == window
    assert sorted(by_seq) == list(range(len(by_seq)))


@pytest.mark.parametrize("window", [16, 2048])
def test_odd_documents(table, odd, window):
    rows = packing.pack(table(odd), VOCAB, window).collect()
    check(rows, odd, window)


def test_given_table(spark):
    from smolt.session import ship_package
    ship_package(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    rows = packing.pack(docs, VOCAB).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 2048)


def test_sequences_and_empty(table, odd):
    p = packing.pack(table(odd), VOCAB, 64).cache()
    seqs = {r["sequence_id"]: r["ids"] for r in packing.sequences(p).collect()}
    rows = p.select("*", F.crc32("ids").alias("c")).collect()
    assert all(zlib.crc32(r["ids"]) == r["c"] for r in rows)
    assert all(seqs[r["sequence_id"]][4 * r["offset"]:4 * (r["offset"] + r["length"])] == r["ids"] for r in rows)
    assert packing.pack(table([]), VOCAB).collect() == []
