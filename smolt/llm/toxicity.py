"""Toxicity by noisy-channel deobfuscation.

A text's disguised spans (leetspeak, letters spaced out, stretched letters)
are restored first: each span is a lattice of the letters that its
characters may stand for, and Viterbi decoding under a character language
model picks the likeliest word. The restored text is then scored: words and
word beginnings that tell toxic from clean texts have weights, and a
logistic curve turns a text's strongest weight, their sum and their number
into the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from smolt.llm.common import give_back, remainder, written

# What a character may stand for, besides itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Characters that are put between the letters of a word to hide it.
GAPS = "-._*~'`^/\\,"
#: Log-probabilities of the channel: a letter as it is, a stand-in, a gap or a stretched letter dropped, a non-letter kept.
KEEP, STAND_IN, DROP, OTHER = math.log(0.9), math.log(0.2), math.log(0.3), math.log(0.01)
#: Order of the character model.
ORDER = 4
_EDGE = "\"'`.,;:?!*#%&()[]{}<>=~-_/\\|^"
_LEFT = _EDGE.replace("!", "").replace("|", "")
# a single character with marks around it: a letter or digit, or else a stand-in
_SINGLE = r"(?:(?:[^\w\s]|_)*+[^\W_](?:[^\w\s]|_)*+(?!\S)|(?:[^\w\s@$!|+(€£]|_)*+\(?[@$!|+(€£](?:[^\w\s]|_)*+(?!\S))"
_SPACED = re.compile(rf"(?<!\S){_SINGLE}(?:[ \t]+{_SINGLE}){{2,}}")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_RUN = re.compile(r"(.)\1{3,}", re.DOTALL)
# marks between words: all, and those that stand for no letter
_MARK = re.compile(r"[\W_]+")
_GLUE = re.compile(r"(?:[^\w@$!|+(€£¡]|_)+")
_GAPPED = re.compile(r"^(?:[^\W_]|[@$!|+(€£]){1,2}(?:[-._*~'`^/\\,]+(?:[^\W_]|[@$!|+(€£]){1,2}){2,}$")


class CharModel:
    """Character n-gram model with absolute back-off, from n-gram counts."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.total: Counter = Counter()
        for g, n in counts.items():
            self.total[g[:-1]] += n
        self.letters = {g for g in counts if len(g) == 1}
        self.memo: dict[str, float] = {}

    def logp(self, history: str, c: str) -> float:
        g = history[-(ORDER - 1):] + c
        if g not in self.memo:
            self.memo[g] = math.log(self._p(g))
        return self.memo[g]

    def _p(self, g: str) -> float:
        below = self._p(g[1:]) if len(g) > 1 else 1 / (len(self.letters) + 30)
        all_ = self.total.get(g[:-1], 0)
        return (self.counts.get(g, 0) + 4 * below) / (all_ + 4)


def grams(word: str) -> Iterator[str]:
    """All n-grams up to ORDER of a word with its ends marked."""
    w = "\x02" + word + "\x03"
    for i in range(1, len(w)):
        for n in range(1, min(ORDER, i + 1) + 1):
            yield w[i - n + 1:i + 1]


def decode(span: str, model: CharModel, breaks: bool = False) -> str:
    """The likeliest word behind ``span``: Viterbi over (last letters) states.

    Each character keeps, becomes a stand-in's letter, or is dropped (a gap,
    or a repeat of the letter before it in a run of three or more). With
    ``breaks`` a gap may also end a word: the likeliest words, set apart by
    blanks. Paths are shared, so the cost is linear in the length.
    """
    runs, at = [1] * len(span), 0
    for i in range(1, len(span) + 1):
        if i == len(span) or span[i] != span[at]:
            runs[at:i] = [i - at] * (i - at)
            at = i
    best: dict[str, tuple[float, tuple | None]] = {"\x02": (0.0, None)}
    for i, c in enumerate(span):
        outs = [(c, KEEP if c.isalpha() else OTHER)] + [(x, STAND_IN) for x in LEET.get(c, "")]
        after: dict[str, tuple[float, tuple | None]] = {}
        for h, (p, word) in best.items():
            steps = [(h[-(ORDER - 2):] + x, p + q + model.logp(h, x), (word, x)) for x, q in outs]
            repeat = i and span[i - 1] == c and runs[i] > 2
            gap = c in GAPS or c.isspace()
            if gap or repeat:
                steps.append((h, p + DROP, word))
            if breaks and gap and h != "\x02":
                steps.append(("\x02", p + DROP + model.logp(h, "\x03"), (word, " ")))
            for s, q, w in steps:
                if s not in after or q > after[s][0]:
                    after[s] = (q, w)
        best = after
    # with breaks, a path may end with a break: its last word is complete
    ends = [(p + (0.0 if breaks and h == "\x02" else model.logp(h, "\x03")), w) for h, (p, w) in best.items()]
    top = max(p for p, _ in ends)
    return max(_letters(w) for p, w in ends if p == top)


def _letters(path: tuple | None) -> str:
    out = []
    while path:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


def disguised(word: str) -> bool:
    """Whether a trimmed word of any length mixes letters with stand-ins,
    stretches a letter, or sets its letters apart."""
    if word.isalpha():
        return bool(_STRETCHED.search(word))
    return bool(_GAPPED.match(word)) or any(c.isalpha() for c in word) and any(c in LEET for c in word)


def collapsed(word: str) -> str:
    """``word`` with runs of one character cut to three, which decode alike."""
    return _RUN.sub(r"\1\1\1", word)


def spaced(text: str) -> list[str]:
    """Spans of three or more single characters set apart by blanks, without
    the marks around them."""
    return [" ".join(_single(t) for t in m[0].split()) for m in _SPACED.finditer(text)]


def _single(token: str) -> str:
    """The letter or digit of a token of ``_SPACED``, or else its stand-in."""
    return next((c for c in token if c.isalnum()), None) or next((c for c in token if c in "@$!|+€£"), "(")


def entries(word: str) -> list[str]:
    """Entries of a restored word: itself and its beginnings."""
    return [word, *("^" + word[:n] for n in (3, 4, 5, 6) if len(word) > n)]


def best(word: str, weights: dict[str, float]) -> float:
    return max(weights.get(e, 0.0) for e in entries(word))


def inside(word: str, weights: dict[str, float], longest: int) -> float:
    """The strongest entry that stands anywhere in ``word``, of three letters or more."""
    return max((weights[e] for i in range(len(word)) for j in range(i + 3, min(len(word), i + longest) + 1)
                if (e := word[i:j]) in weights), default=0.0)


def features(hits: list[float], n_words: int) -> list[float]:
    """What the curve sees of a text: its hits' weights and its length."""
    return [1.0, max(hits, default=0.0), min(sum(hits), 40.0), math.log1p(len(hits)), math.log1p(n_words)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return w


class Restorer:
    """Restored words of texts; each distinct word is decoded once."""

    def __init__(self, counts: dict[str, int], most: int = 200_000):
        self.model, self.most, self.known, self.glued, self.longest = CharModel(counts), most, {}, {}, 0

    def word(self, raw: str) -> str:
        if raw not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
                self.glued.clear()
            w = raw if raw.isalpha() else raw.rstrip(_EDGE).lstrip(_LEFT)
            if w.endswith("$$$"):
                w = w.rstrip("$")
            self.known[raw] = self._read(w)
            if _MARK.search(w) and disguised(w) and (glued := self._split(w, self.known[raw])):
                self.glued[raw] = glued
        return self.known[raw]

    def _read(self, w: str) -> str:
        return decode(collapsed(w), self.model) if disguised(w) else w

    def _split(self, w: str, word: str) -> list[str]:
        """Words that marks glue together in ``w``: read with word ends at
        gaps, and, unless its letters are set apart, mark by mark."""
        found = _MARK.split(decode(collapsed(w), self.model, True))
        if not _GAPPED.match(w):
            found += [self._read(x) for x in _GLUE.split(w)]
        return [x for x in dict.fromkeys(found) if x and x != word]

    def parts(self, raw: str) -> list[str]:
        """The restored word, then the words that marks glue together in it."""
        word = self.word(raw)
        return [word, *self.glued.get(raw, ())]

    def span(self, s: str) -> list[str]:
        """The words of a spaced span, then the span read as one word."""
        whole = decode(s, self.model)
        words = decode(s, self.model, True).split() if any(c.isalpha() for c in s) else []
        return [*(words if words != [whole] else []), whole]

    def words(self, text: str) -> list[str]:
        """The restored text's words: in order, then those of spaced spans."""
        text = text.lower()
        return [x for w in text.split() for x in self.parts(w)] + [w for s in spaced(text) for w in self.span(s)]

    def span_hits(self, s: str, weights: dict[str, float]) -> list[float]:
        """Weights of a spaced span's words; of the span as one word, or of an
        entry anywhere in it, where that is stronger. Spans mostly of digits
        are not searched for entries: tables of digits would hit by chance."""
        *words, whole = self.span(s)
        hits = [p for w in words if (p := best(w, weights))]
        other = best(whole, weights)
        if sum(c.isalpha() for c in s) * 2 > len(s.split()):
            self.longest = self.longest or max(map(len, weights), default=1)
            other = max(other, inside(whole, weights, self.longest), inside("".join(words), weights, self.longest))
        return [*hits, other] if other > max(hits, default=0.0) else hits

    def features(self, text: str, weights: dict[str, float], seen: dict[str, float]) -> list[float]:
        """``features`` of a text; ``seen`` remembers raw words' weights."""
        text, hits = text.lower(), []
        raw = text.split()
        for w in set(raw):
            p = seen.get(w)
            if p is None:
                if len(seen) >= self.most:
                    seen.clear()
                p = seen[w] = max(best(x, weights) for x in self.parts(w))
            if p:
                hits.append(p)
        hits += [p for s in set(spaced(text)) for p in self.span_hits(s, weights)]
        return features(hits, len(raw))


def _texts(b: pa.RecordBatch, i: int) -> list[str]:
    return [t or "" for t in b.column(i).to_pylist()]


def _counts(c: Counter, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names)


def _word_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of words, weighted by the words' counts."""
    for b in batches:
        c: Counter = Counter()
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            w = w.strip(_EDGE)
            if len(w) <= 20 and w.isalpha() and not _STRETCHED.search(w):
                for g in grams(w):
                    c[g] += n
        yield _counts(c, ["e", "n"])


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
          rows: int = 20_000, entries_most: int = 50_000, grams_most: int = 200_000) -> dict:
    """Fit the character model, the entries' weights and the curve.

    ``learn`` tells of a label row's id whether it may be used. Bounds: at
    most about ``rows`` labelled rows of each class (chosen by a hash of the
    id), ``entries_most`` entries and ``grams_most`` character n-grams, the
    most frequent over the texts of all ``docs``, labelled or not. Rows
    with a null id, label or text teach nothing; an id with several labels
    counts as toxic if one of them says so. A quarter of the sample (equal
    texts together) only fits the curve, on entries that the rest chose. An
    entry's evidence is counted in texts and in distinct neighbourhoods, and
    the weaker count holds: copies of a text, exact or near, do not make its
    words toxic, nor does one text that repeats a word.
    """
    lab = (labels.where(learn & F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
           .groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic")))
    n = {r["toxic"]: r["count"] for r in lab.groupBy("toxic").count().collect()}
    share = {k: min(1.0, rows / max(1, v)) for k, v in n.items()}
    pick = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, share.get(1, 1.0) * 1e6).otherwise(
        share.get(0, 1.0) * 1e6)
    chosen = lab.where(pick)  # about 2 * rows rows of two numbers: small by its bound
    sample = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
                     .where("text IS NOT NULL").join(F.broadcast(chosen), "id").select("text", "toxic"), "toxic-sample")
    curve = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    sample, aside = sample.where(~curve), sample.where(curve)
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = size.get(1, 0), sum(v for k, v in size.items() if k != 1)

    # each word of the corpus is cut into n-grams once, with the number of its texts
    text = F.lower(F.col(text_col).cast("string"))
    words = docs.select(F.explode(F.array_distinct(F.split(text, r"[\s\x1C-\x1F\x85\p{Z}]+"))).alias("w")).groupBy("w").count()
    found = (words.mapInArrow(_word_grams, "e string, n long").groupBy("e").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "e").limit(grams_most).collect())
    model = {r["e"]: r["n"] for r in found}
    # without hits: the classes' odds; replaced by the fitted curve below
    prior = math.log((pos + 0.5) / (neg + 0.5)) if pos and neg else -5.0
    theta = [prior, 1.0, 0.0, 0.0, 0.0]
    if not pos:
        return {"grams": model, "weights": {}, "theta": theta}

    def count_entries(only: set | None):
        def run(batches):
            restore, c = Restorer(model), Counter()
            for b in batches:
                for t in _texts(b, 0):
                    e = {x for w in set(restore.words(t)) for x in entries(w)}
                    c.update(e if only is None else e & only)
            yield _counts(c, ["e", "n"])
        return run

    def counted(rows_: DataFrame, only: set | None, least: int) -> dict[str, int]:
        c = rows_.select("text").mapInArrow(count_entries(only), "e string, n long").groupBy("e").agg(F.sum("n").alias("n"))
        return {r["e"]: r["n"] for r in c.where(F.col("n") >= least).orderBy(F.desc("n"), "e").limit(entries_most).collect()}

    toxic = counted(sample.where("toxic = 1"), None, 5)
    clean = counted(sample.where("toxic <> 1"), set(toxic), 1)
    likely = {e for e, a in toxic.items() if a / pos > 2 * clean.get(e, 0) / max(1, neg)}

    def count_places(batches):
        restore = Restorer(model)
        for b in batches:
            seen: set = set()
            for t, y in zip(_texts(b, 0), b.column(1).to_pylist()):
                ws = restore.words(t)
                for i, w in enumerate(ws):
                    for e in entries(w):
                        if e in likely:
                            seen.add((e, int(y == 1), " ".join(ws[max(0, i - 1):i + 2])))
            e, y, place = zip(*seen) if seen else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.string()), pa.array(y, pa.int32()), pa.array(place, pa.string())],
                                             ["e", "y", "place"])

    places = (sample.mapInArrow(count_places, "e string, y int, place string").distinct()
              .groupBy("e").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).collect())
    # a chance entry among so many candidates has less evidence than this
    least = 2 * math.log(len(likely) + 1) + 8
    weights = {}
    for r in places:
        a, b = min(r["a"], toxic[r["e"]]), max(r["b"], clean.get(r["e"], 0))
        if a and _evidence(a, b, pos, neg) >= least:
            weights[r["e"]] = math.log((a + 0.5) / (pos + 1)) - math.log((b + 0.5) / (neg + 1))

    def seen_features(batches):
        restore, seen = Restorer(model), {}
        for b in batches:
            rows_ = [[*restore.features(t, weights, seen), float(y == 1)] for t, y in zip(_texts(b, 0), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows_, pa.list_(pa.float64()))], ["x"])

    rows_ = np.array([r["x"] for r in aside.mapInArrow(seen_features, "x array<double>").collect()])
    if len(rows_) and 0 < rows_[:, -1].sum() < len(rows_):
        theta = logistic(rows_[:, :-1], rows_[:, -1]).tolist()
    return {"grams": model, "weights": weights, "theta": theta}


def _evidence(a: int, b: int, pos: int, neg: int) -> float:
    """Log-likelihood ratio of a toxic rate a / (a + b) against the classes' rate."""
    n, q = a + b, pos / (pos + neg) if neg else 1.0
    return 2 * ((a * math.log(a / n / q) if a else 0) + (b * math.log(b / n / (1 - q)) if b else 0)) if a / n > q else 0.0


def score(docs: DataFrame, model: dict, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a double column ``out`` between 0 and 1, from the whole
    restored text, however long. Null and empty texts score as texts without
    a hit; other columns pass unchanged (a column named as ``out`` is
    replaced); equal texts get equal scores; an empty table gives no rows.
    """
    counts, weights, theta = model["grams"], model["weights"], np.array(model["theta"])

    @pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restore, seen = Restorer(counts), {}
        for texts in batches:
            x = np.array([restore.features(t or "", weights, seen) for t in texts]).reshape(-1, len(theta))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ theta, -30, 30))), dtype="float64")
        del restore, seen
        give_back()

    return docs.withColumn(out, scored(F.col(text_col).cast("string")))


def fold(key: Column) -> Column:
    """Rows of this remainder are held out of training."""
    return remainder(key, 5) == 0
