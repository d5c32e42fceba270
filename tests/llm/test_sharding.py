import zlib

import pytest
from pyspark.sql import functions as F

from smolt.llm import sharding as S
from llm_fixtures import odd, table  # noqa: F401


def check(rows, docs, shards, slack):
    """Sizes and checksums, gapless slots, near equal bytes."""
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(shards))
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for k in range(shards):
        assert abs(sum(r["size"] for r in by.get(k, [])) - total / shards) <= most + slack * total / shards


@pytest.mark.parametrize("cell_rows", [7, 50_000])
def test_given_table(spark, cell_rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = S.histogram_shards(docs, 10, cell_rows=cell_rows).collect()
    check(got, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 10, 0.01)


def test_hot_text_and_equal_rows_are_split(table):
    rows = [(i, "the same text") for i in range(300)] + [(7, "one row many times")] * 300 + [(1000 + i, f"text {i}") for i in range(300)]
    got = S.histogram_shards(table(rows).repartition(5), 9).collect()
    check(got, rows, 9, 0.01)
    assert len({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"one row many times")}) >= 3


def test_slots_follow_the_key(table):
    """Shards are consecutive key ranges, and slots run in key order."""
    rows = [(i, f"t{i % 40}") for i in range(200)]
    got = S.histogram_shards(table(rows), 4, cell_rows=5)
    keyed = got.withColumn("h", F.lpad(F.hex(F.xxhash64("text")), 16, "0")).orderBy("shard", "slot").collect()
    assert [r["h"] for r in keyed] == sorted(r["h"] for r in keyed)


def test_odd_documents(table, odd):
    check(S.histogram_shards(table(odd), 3).collect(), odd, 3, 0.01)
    assert len(S.histogram_shards(table(odd), 40).collect()) == len(odd)
    assert S.histogram_shards(table([]), 40).collect() == []
    assert set(S.histogram_shards(table(odd), 3).columns) == {"doc_id", "text", "lang", "source", "n_chars", "quality", "fp", "row", "id",
                                                              "size", "text_crc32", "shard", "slot"}
