import numpy as np
import pytest

import corpus_pipeline as C
from test_packing import check
from test_simhash import expected as simhash_classes
from test_suffixes import brute
from llm_fixtures import odd, table  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before and after every stage, each written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(C.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(steps):
    for name, before, after in steps[:-1]:
        assert sorted(before.columns) == sorted(after.columns), name


def test_filters_take_effect(spark, steps):
    from smolt.llm.queries import QUERIES
    kept = {r["doc_id"] for r in QUERIES["op4_quality_rules"](spark, SF).where("kept").collect()}
    assert set(rows(steps[0][2])) == kept
    before, after = rows(steps[1][1]), rows(steps[1][2])
    assert all(before[i] == r for i, r in after.items())
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert len(toxic & set(before) - set(after)) <= 0.05 * len(toxic & set(before))


def test_one_of_each_class(steps):
    before, after = rows(steps[2][1]), rows(steps[2][2])
    classes = simhash_classes([(i, r["text"]) for i, r in before.items()])
    assert set(after) == {c for *_, c in classes} and all(before[i] == r for i, r in after.items())


def test_passages_are_cut(steps):
    before, after = rows(steps[3][1]), rows(steps[3][2])
    found = {k[0]: cuts for k, (_, cuts) in brute([(i, r["text"]) for i, r in before.items()], 50).items()}
    assert set(before) == set(after)
    for i, r in after.items():
        words = before[i]["text"].split()
        assert r["text"].split() == [w for k, w in enumerate(words) if k not in found.get(i, ())]
        assert r["n_chars"] == (len(r["text"]) if found.get(i) else before[i]["n_chars"])


def test_packed(spark, steps):
    _, before, after = steps[4]
    check(after.collect(), [(r["doc_id"], r["text"]) for r in before.collect()], 2048)
    done = C.run(spark, SF).collect()
    assert sum(r["length"] for r in done) == sum(r["length"] for r in after.collect())
    assert np.array_equal(sorted({r["doc_id"] for r in done}), sorted(rows(before)))


def test_odd_rows(spark, table, odd):
    for name, stage in C.STAGES:
        for docs in (table(odd), table([])):
            got = stage(spark, docs, SF)
            if name != "packing":
                assert sorted(got.columns) == sorted(docs.columns)
            assert got.count() <= 40
