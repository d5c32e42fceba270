import re

import pytest
from pyspark.sql import functions as F

from smolt.llm import quality as Q
from llm_fixtures import odd, table  # noqa: F401


def measures(text):
    """The contract, word by word."""
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", t) if w]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 2000 else set(range(len(words)))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice))


def test_measures(table, odd):
    texts = [t for _, t in odd] + ["a b c a b c d", "x\ny\nx\n \n\n x", "a a a a", "ab cd \U0001F600 é"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["quality"] for r in Q.score_quality(table(rows)).collect()}
    for i, t in rows:
        q = got[i]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == measures(t), t
        assert q["kept"] == (len(q["failed"]) == 0)


@pytest.mark.parametrize("rule,text", [
    ("too_short", "the end"), ("repeated_windows", "of the word " * 40), ("symbols", "the wo### rd " * 3 + " ".join(f"the w{i}#" for i in range(60))),
    ("exclamation", " ".join(f"the w{i}!" for i in range(60))), ("word_length", " ".join(f"the {i:050d}" for i in range(60))),
    ("stop_words", " ".join(f"word{i}" for i in range(80)))])
def test_rules(table, rule, text):
    assert rule in Q.score_quality(table([(1, text)])).collect()[0]["quality"]["failed"]


def test_clean_text_is_kept_and_filters_apply(table):
    clean = " ".join(f"the w{i} of" for i in range(40))
    df = Q.score_quality(table([(1, clean), (1, clean), (2, "short"), (None, None)]))
    assert [r["doc_id"] for r in df.where(F.col("quality")["kept"]).collect()] == [1, 1]
    assert Q.score_quality(table([])).collect() == []


def test_own_table_of_rules(table):
    rules = (Q.Rule("long", "n_words", high=3), Q.Rule("lines", "dup_line_ratio", high=0.1, from_words=3))
    got = {r["doc_id"]: r["quality"]["failed"] for r in Q.score_quality(table([(1, "a b c d"), (2, "a\na"), (3, "a\na\na")]), rules).collect()}
    assert got == {1: ["long"], 2: [], 3: ["lines"]}
