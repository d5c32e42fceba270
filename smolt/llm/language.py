"""Language identification: multinomial naive Bayes over hashed character
n-grams. The log-probability matrix (languages x buckets) is broadcast; a
batch of texts is one sparse row set (n-gram buckets, row ends), scored by
gathering matrix columns and summing them between row ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smolt.llm.common import remainder
from smolt.llm.packing import chunks

ORDERS = (1, 2, 3)
#: Largest broadcast matrix in bytes (buckets are halved until it fits), and most languages.
MATRIX, LANGUAGES = 64 << 20, 1024
UNKNOWN = "und"
_WORDLIKE = re.compile(r"[^\W\d_]")  # letters, and number signs such as ² or Ⅷ


def fold(key: Column) -> Column:
    """Rows of this remainder are held out of training."""
    return remainder(key, 4) == 2


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def ngrams(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of every n-gram of the lower-cased texts,
    and the row ends (len(texts) + 1 offsets)."""
    texts = [t.lower() for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum([0, *map(len, texts)])
    mixed = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        mixed = (mixed[:len(codes) - n + 1] * np.uint64(0x100000001B3)) ^ codes[n - 1:]
        if n not in ORDERS:
            continue
        last = np.maximum(ends[1:] - n + 1, ends[:-1])  # n-grams begin before this
        inside = np.ones(len(mixed), bool)
        for k in range(1, n):  # starts whose n-gram would cross a row end
            cross = ends[1:] - k
            inside[cross[(cross >= 0) & (cross < len(mixed))]] = False
        rows = np.concatenate(([0], np.cumsum(last - ends[:-1])))
        h = (mixed + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        yield (h[inside] >> np.uint64(33)).astype(np.int64) % buckets, rows


def train(docs: DataFrame, learn: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
          rows_per_lang: int = 5_000, buckets: int = 1 << 15, alpha: float = 0.5) -> dict:
    """Fit languages, priors and the log-probability matrix.

    Learns from rows with a text and a language where ``learn`` holds: about
    ``rows_per_lang`` of each language at most, chosen by a hash of the id
    and text (the documented bound of the sample). Priors count all rows.
    Raises ValueError for more than ``LANGUAGES`` languages.
    """
    rows = docs.where(learn).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"),
                       F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(n) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    langs = sorted(n)
    if not langs:
        return {"langs": [], "prior": np.zeros(0), "matrix": np.zeros((0, 1), np.float32)}
    while len(langs) * buckets * 4 > MATRIX:
        buckets //= 2
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1e6, 1e6 * rows_per_lang / n[k]))]), F.col("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros((len(langs), buckets), np.int64)
        for b in batches:
            own, texts = np.array(b.column(0).to_pylist()), b.column(1).to_pylist()
            for lo, hi in chunks(texts, 1 << 21):
                for i, lang in enumerate(langs):
                    part = [t for t, y in zip(texts[lo:hi], own[lo:hi]) if y == lang]
                    for idx, _ in ngrams(part, buckets) if part else ():
                        c[i] += np.bincount(idx, minlength=buckets)
        i, j = np.nonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(c[i, j])], ["i", "j", "n"])

    found = (rows.where(F.pmod(F.col("h"), F.lit(1_000_000)) < share).select("lang", "text")
             .mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow())
    c = np.full((len(langs), buckets), alpha)
    c[found["i"].to_numpy(), found["j"].to_numpy()] += found["n"].to_numpy()
    prior = np.log(np.array([n[k] for k in langs]) / sum(n.values()))
    return {"langs": langs, "prior": prior, "matrix": np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32)}


def scores(texts: list[str], prior: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Log-joint of every text (rows) and language (columns)."""
    out = np.tile(prior, (len(texts), 1))
    for idx, rows in ngrams(texts, matrix.shape[1]):
        for k in range(len(prior)):
            total = np.concatenate(([0.0], np.cumsum(matrix[k][idx], dtype=np.float64)))
            out[:, k] += total[rows[1:]] - total[rows[:-1]]
    return out


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row, from its whole text.

    ``score`` is the posterior of the predicted language; ties go to the
    first language by name; a very long text is scored whole. A null or empty
    text, one without a letter (number signs are none), or
    a model without languages gives 'und' and 0. Repeated rows are each
    scored; other columns are not read; an empty table gives no rows.
    """
    langs, prior = np.array([*model["langs"], UNKNOWN]), model["prior"]
    shared = docs.sparkSession.sparkContext.broadcast(model["matrix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            pred, top = np.full(len(texts), len(prior)), np.zeros(len(texts))
            known = np.array([has_letter(t) for t in texts], bool)
            if len(prior):
                for lo, hi in chunks(texts, 1 << 20):
                    s = scores(texts[lo:hi], prior, shared.value)
                    pred[lo:hi] = s.argmax(axis=1)
                    top[lo:hi] = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
                pred, top = np.where(known, pred, len(prior)), np.where(known, top, 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs[pred], pa.string()), pa.array(top)],
                                             [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
