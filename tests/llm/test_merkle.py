import hashlib
import zlib

import pytest
from llm_fixtures import odd, table  # noqa: F401
from pyspark.sql import functions as F

from smolt.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute(rows, fanout):
    """rows: (group, key, leaf, replacement). By key: leaf, subroot, root,
    digest of the siblings, root recomputed from the replacement."""
    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            row = levels[-1]
            levels.append([H(*row[i:i + fanout]) for i in range(0, len(row), fanout)])
        return levels

    def way(levels, i, new):
        proof = []
        for row in levels[:-1]:
            run = i - i % fanout
            proof += row[run:i] + row[i + 1:run + fanout]
            new = H(*row[run:i], new, *row[i + 1:run + fanout])
            i //= fanout
        return proof, new

    groups = {}
    for g, k, leaf, new in rows:
        groups.setdefault(g, []).append((k is not None, k or 0, leaf, k, new))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for n, g in enumerate(order):
        for i, (_, _, leaf, k, new) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            p1, new = way(trees[g], i, new or leaf)
            p2, new = way(top, n, new)
            out.append((k, leaf, trees[g][-1][0], top[-1][0], H(*p1, *p2), new))
    return sorted(out, key=str)


def found(df):
    text = lambda c: F.lower(F.hex(c))
    rows = df.select("key", text("leaf"), text("subroot"), text("root"), F.sha2(text("siblings"), 256), text("folded")).collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("fanout,levels", [(2, 1), (2, 3), (3, 2), (5, 10)])
def test_against_one_tree(spark, fanout, levels):
    sizes = {None: 3, "a": 1, "b": 41, "é": 8, "Z": 9, "": 2}
    rows = [(g, k, H(f"{g}{k}"), H(f"new{k}") if k % 4 == 0 else None) for g, n in sizes.items() for k in range(n)]
    rows += [("b", None, H("x"), None), ("b", 7, H("b7"), None), ("b", 7, H("b7"), None), ("b", 7, H("another"), None)]
    df = spark.createDataFrame(rows, "g string, pos int, leaf string, total string").repartition(5)
    got = merkle.manifest(df, F.unhex("leaf"), F.col("g"), F.col("pos"), F.unhex("total"), fanout, levels)
    assert found(got) == brute(rows, fanout)


def test_one_leaf_and_no_leaf(spark):
    one = spark.createDataFrame([("a", 1, H("x"))], "g string, k int, leaf string")
    assert found(merkle.manifest(one, F.unhex("leaf"), F.col("g"), F.col("k"))) == [(1, H("x"), H("x"), H("x"), H(""), H("x"))]
    assert merkle.manifest(one.limit(0), F.unhex("leaf"), F.col("g"), F.col("k")).collect() == []


def test_states_skip_left_siblings():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(11)]
    tree = merkle.Subtree(digests, merkle.height(11, 3), 3)
    changed = list(digests)
    changed[7] = hashlib.sha256(b"new").digest()
    want = merkle.Subtree(changed, merkle.height(11, 3), 3).rows[-1][0]
    tree.rows[0][6] = b"lost"  # left of the slot: in the retained state, not read again
    assert tree.fold(7, changed[7].hex().encode()) == want


def test_query_on_odd_documents(spark, table, odd, tmp_path):
    from smolt.llm.queries import QUERIES
    docs = table(odd + [(70, "y" * 3_000_000)])
    docs.withColumn("lang", F.when(F.col("doc_id") > 6, F.lit("fr")).when(F.col("doc_id") < 3, None).otherwise(F.col("lang"))
                    ).write.parquet(f"{tmp_path}/documents.parquet")

    def leaf(r, more=0):
        n = None if r["n_chars"] is None else r["n_chars"] + more
        part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
        return H(*map(part, (r["doc_id"], r["source"], r["lang"], n, r["text"])))

    rows = []
    for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect():
        i = r["doc_id"]
        rows.append((r["lang"], i, leaf(r), leaf(r, 1) if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else None))
    want = [(*x, x[5] == x[3]) for x in brute(rows, 2)]
    got = QUERIES["op12_merkle"](spark, str(tmp_path)).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == want
