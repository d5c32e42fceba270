import pytest

COLS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    """Build a documents table from (doc_id, text) pairs, with extra columns
    whose names clash with the operators' own."""
    from smolt.session import ship_package

    def make(rows, extra="size long, key string, shard int, quality string, fp long, row int, id int"):
        ship_package(spark)
        n = len(extra.split(",")) if extra else 0
        full = [(i, t, "en", "s", None if t is None else len(t), *[None] * n) for i, t in rows]
        return spark.createDataFrame(full, COLS + (", " + extra if extra else ""))
    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, repeated rows, a long text, odd letters."""
    return [(1, "the cat sat on the mat. " * 3), (2, None), (3, ""), (4, " \t\n "), (None, "a b c"), (None, "a b c"),
            (5, "Émile's naïve café — 1,234 «ok»!? don't <|endoftext|> x y"), (6, "word " * 5000), (7, "x"),
            (1, "the cat sat on the mat. " * 3), (8, "# * $ % & | < > " * 20), (-9, "L'été\u0085 zwölf\x1fein İstanbul ΣΑΣ ſ")]
