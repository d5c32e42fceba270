import itertools
import math

import pytest
from pyspark.sql import functions as F

from smolt.llm import toxicity as X
from llm_fixtures import odd, table  # noqa: F401

WORDS = "the cat sat on a mat and the dog ran to a stupid person idiot moron scum trash people read books every day".split()


@pytest.fixture(scope="module")
def grams():
    out = {}
    for w in WORDS:
        for g in X.grams(w):
            out[g] = out.get(g, 0) + 1
    return out


@pytest.mark.parametrize("seen,word", [
    ("1d10t", "idiot"), ("id-i-o-t", "idiot"), ("!d!0t", "idiot"), ("i.d.i.o.t", "idiot"), ("m0r0n", "moron"), ("idiooot", "idiot"),
    ("$cum", "scum"), ("5tup1d", "stupid"), ("tr@sh!!!", "trash"), ("books", "books"), ("day,", "day"), ("42", "42")])
def test_words_are_restored(grams, seen, word):
    assert X.Restorer(grams).word(seen) == word


def test_spaced_spans(grams):
    assert X.Restorer(grams).words("he is an I D I O T")[-1] == "idiot"
    assert X.spaced("a cat is on a mat") == []


@pytest.mark.parametrize("text,word", [
    ("you are a l o s e r today", "loser"), ("eres y s t u p i d o", "stupido"), ("y o u a r e s t u p i d", "stupid"),
    ('"s t u p i d"', "stupid"), ("such s t u p i d, yes", "stupid")])
def test_spaced_words_beside_single_characters_and_marks(grams, text, word):
    """The word's weight is found, however its neighbours are written."""
    weights = {word: 3.0}
    got = X.Restorer(grams).features(text, weights, {})
    assert got[:3] == [1.0, 3.0, 3.0]


def test_spaced_spans_are_split_into_words():
    words = "you are a stupid person loser and the dog ran".split() * 20
    grams = {}
    for w in words:
        for g in X.grams(w):
            grams[g] = grams.get(g, 0) + 1
    got = X.Restorer(grams).words('they said: "y o u a r e 5 t u p 1 d", and a l o s e r.')
    assert {"you", "are", "stupid", "loser"} <= set(got)
    assert X.spaced('(c u n) ! d !0 "x, 5 7') == ["c u n ! d 0 x 5 7"]
    assert X.spaced("(. a b") == ["( a b"]
    assert X.spaced("!" * 20_000 + " a b") == ["! a b"]


@pytest.mark.parametrize("seen", [
    "1d10" + "0" * 40 + "t", "1" + "-" * 10 + "d" + "-" * 10 + "1" + "_" * 12 + "0" + "." * 15 + "t",
    "the-people-read-books/every-day/1d10t/and-the-dog-ran-to-a-mat", "people=the:dog;1d10t=every:day?books=person&people=the"])
def test_long_tokens_are_decoded(grams, seen):
    assert len(seen) > 40 and X.Restorer(grams).features(seen, {"idiot": 3.0}, {})[1] == 3.0


def test_long_tokens_cost_in_proportion(grams):
    assert X.Restorer(grams).words("a1-b2/" * 5_000)
    assert X.Restorer(grams).word("1d10" + "0" * 1_000_000 + "t") == "idiot"


def test_long_spans_cost_in_proportion(grams):
    assert len(X.Restorer(grams).span(" ".join("stupid" * 5_000))[-1]) > 10_000


def test_viterbi_is_the_best_path(grams):
    """Against every reading of the lattice."""
    m = X.CharModel(grams)
    for span in ("1d10t", "m-0-r", "caaat", "5cum"):
        options = []
        for i, c in enumerate(span):
            o = [(c, X.KEEP if c.isalpha() else X.OTHER)] + [(x, X.STAND_IN) for x in X.LEET.get(c, "")]
            if c in X.GAPS or span[i - 1:i] == c and "aaa" in span:
                o.append(("", X.DROP))
            options.append(o)

        def total(path):
            w, p = "\x02", 0.0
            for x, q in path:
                p += q + (m.logp(w, x) if x else 0)
                w += x
            return p + m.logp(w, "\x03")
        paths = list(itertools.product(*options))
        top = max(map(total, paths))
        got = X.decode(span, m)
        assert any(math.isclose(total(p), top) and "".join(x for x, _ in p) == got for p in paths)


def test_held_out_accuracy(spark):
    from smolt.llm.queries import QUERIES
    from smolt.session import ship_package
    ship_package(spark)
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op2_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] != r["toxic"] for r in held) <= 0.08 * len(held)
    assert sum(r["predicted"] and not r["toxic"] for r in held) <= 0.03 * len(held)


def test_the_character_model_counts_all_documents(spark, table):
    """Also texts without a label, and a word once for each text."""
    texts = ["the cat sat", "the zebra and the zebra", None, "a qu1ck walk, zebra."]
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    got = X.train(table(list(enumerate(texts))), labels, F.lit(True))["grams"]
    want = {}
    for w in ["the", "cat", "sat", "the", "zebra", "and", "a", "walk", "zebra"]:
        for g in X.grams(w):
            want[g] = want.get(g, 0) + 1
    assert got == want


def test_odd_tables(spark, table, odd):
    docs = table(odd)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = X.train(docs, none, ~X.fold(F.col("doc_id")))
    got = X.score(docs, model).collect()
    assert len(got) == len(odd) and all(0 <= r["toxicity"] < 0.5 for r in got)
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (6, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    assert X.score(docs, X.train(docs, labels, F.lit(True))).count() == len(odd)
    assert X.score(table([]), X.train(table([]), labels, F.lit(True))).collect() == []
