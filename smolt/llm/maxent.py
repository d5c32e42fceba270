"""LM scoring with a hashed maximum-entropy model.

A token's probability is P(class | context) * P(token | class, context).
Frequent tokens (the head) are in classes of 32 by frequency, chosen by a
second softmax over the class; all other words are in classes by their last
two bytes, with add-one probabilities from the corpus counts, so the model
also covers words it never saw. Context features: the token before, skips
of one and two tokens, and the hashed pair of the two tokens before.

Counts cover every training text. The weights are trained by distributed
gradient updates: in each round every task makes AdaGrad steps on its share
of the texts, and the tasks' changes are averaged row by row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smolt.llm.common import remainder, written
from smolt.llm.tokens import Words, bytes_of, mix, text_chunks

#: Head classes and their size, classes of other words.
HEAD_CLASSES, CLASS_SIZE, FORM_CLASSES = 32, 32, 32
HEAD = HEAD_CLASSES * CLASS_SIZE
CLASSES = HEAD_CLASSES + FORM_CLASSES
#: Context symbols: head tokens, form classes, text start.
SYMBOLS = HEAD + FORM_CLASSES + 1
PAIRS, IN_CLASS = 1 << 12, 1 << 12
ROWS = 1 + 3 * SYMBOLS + PAIRS
IN_ROWS = HEAD_CLASSES + 2 * IN_CLASS
END = np.uint64(0x5EED0F0E5EED0F0E)
ROUNDS, BATCH, RATE, DAMP = 2, 16_384, 0.5, 10.0
#: Weights travel in this many blocks, so that many tasks share their sums.
BLOCKS = 256
#: Distinct tokens that a counting task holds before it passes them on.
HELD = 1_000_000


@dataclass
class Batch:
    """Tokens of some texts: hash, text, form class, and the text's first token."""

    token: np.ndarray
    row: np.ndarray
    form: np.ndarray
    first: np.ndarray


def read(data: np.ndarray, at: np.ndarray) -> Batch:
    """Tokens of texts: lower-cased words, then one end per text."""
    w = Words(data, at, lower=True)
    n = len(at) - 1
    size = np.diff(w.row) + 1
    first = np.cumsum(size) - size
    text = np.repeat(np.arange(n), size - 1)
    place = np.arange(len(w.hash)) + text
    token = np.full(int(size.sum()), END)
    token[place] = w.hash
    form = np.zeros(len(token), np.int64)
    last = data[w.end - 1].astype(np.int64) if len(w.end) else np.zeros(0, np.int64)
    before = np.where(w.end - w.start > 1, data[np.maximum(w.end - 2, 0)] if len(w.end) else 0, 0).astype(np.int64)
    fold = lambda x: np.where((x >= 65) & (x <= 90), x + 32, x)
    form[place] = (mix((fold(before) * 256 + fold(last)).astype(np.uint64)) % np.uint64(FORM_CLASSES)).astype(np.int64)
    return Batch(token, np.repeat(np.arange(n), size), form, first)


@dataclass
class Model:
    """What a task needs: bounded by the constants above."""

    head: np.ndarray       # hashes of the head, sorted
    rank: np.ndarray       # their rank by frequency: class rank // 32, member rank % 32
    log_count: np.ndarray  # log10(c + 1) of each rank
    form_mass: np.ndarray  # log10(N_k + V_k + 1) of each form class
    total: float           # log10(N + V + 1)
    classes: np.ndarray    # weights: ROWS x CLASSES
    members: np.ndarray    # weights: IN_ROWS x CLASS_SIZE

    def symbols(self, b: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each token, and whether it is in the head."""
        k = np.searchsorted(self.head, b.token)
        k[k == len(self.head)] = 0
        known = self.head[k] == b.token if len(self.head) else np.zeros(len(b.token), bool)
        rank = self.rank[k] if len(self.head) else k
        return np.where(known, rank, HEAD + b.form), known


def context(sym: np.ndarray, b: Batch) -> np.ndarray:
    """Feature rows of each token: bias, s1, s2, s3 and the pair (s1, s2)."""
    at = np.arange(len(sym)) - b.first[b.row]
    out = np.zeros((len(sym), 5), np.int32)
    s = []
    for k in (1, 2, 3):
        x = np.full(len(sym), SYMBOLS - 1)
        x[k:] = np.where(at[k:] >= k, sym[:-k] if k < len(sym) else sym[:0], SYMBOLS - 1)
        s.append(x)
        out[:, k] = 1 + (k - 1) * SYMBOLS + x
    pair = mix((s[0] * SYMBOLS + s[1]).astype(np.uint64)) % np.uint64(PAIRS)
    out[:, 4] = 1 + 3 * SYMBOLS + pair.astype(np.int32)
    return out


def inner(cls: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Feature rows of the choice inside a head class."""
    out = np.empty((len(cls), 3), np.int32)
    out[:, 0] = cls
    for k in (1, 2):
        h = mix((rows[:, k].astype(np.uint64) * np.uint64(HEAD_CLASSES) + cls.astype(np.uint64)) * np.uint64(2 * k + 1))
        out[:, k] = HEAD_CLASSES + (k - 1) * IN_CLASS + (h % np.uint64(IN_CLASS)).astype(np.int32)
    return out


def log_softmax(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = w[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        z = z + w[rows[:, k]]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _step(w: np.ndarray, power: np.ndarray, seen: np.ndarray, rows: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One AdaGrad step on a batch."""
    g = np.exp(log_softmax(w, rows))
    g[np.arange(len(target)), target] -= 1
    flat, k = rows.T.reshape(-1), rows.shape[1]
    used = np.unique(flat)
    slot = np.searchsorted(used, flat)
    total = np.stack([np.bincount(slot, np.tile(g[:, c], k), len(used)) for c in range(w.shape[1])], axis=1)
    seen[used] += np.bincount(slot, minlength=len(used))
    power[used] += total * total
    w[used] -= (rate * total / np.sqrt(power[used])).astype(np.float32)


def _runs(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, int, int, Batch]]:
    for b in batches:
        data, at = bytes_of(b.column(text))
        for lo, hi in text_chunks(at, 1 << 20):
            yield b, lo, hi, read(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, form, c) of all texts. Each task sums what it holds, so a very
    common token reaches the exchange a few times per task."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            tok = np.concatenate([x[0] for x in held])
            u, i, inv = np.unique(tok, return_index=True, return_inverse=True)
            c = np.bincount(inv, np.concatenate([x[2] for x in held]), len(u)).astype(np.int64)
            return u, np.concatenate([x[1] for x in held])[i], c

        for _, _, _, t in _runs(batches, 0):
            u, i, c = np.unique(t.token, return_index=True, return_counts=True)
            held.append((u, t.form[i], c))
            size += len(u)
            if size > 2 * HELD:
                held = [flush()]
                size = len(held[0][0])
                if size > HELD:
                    yield _counted(held.pop())
                    size = 0
        if held:
            yield _counted(flush())

    def _counted(x):
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])],
                                          ["token", "form", "c"])

    return texts.mapInArrow(run, "token long, form int, c long").groupBy("token").agg(
        F.max("form").alias("form"), F.sum("c").alias("c"))


def train(texts: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> tuple[Model, int]:
    """The model and the number of training tokens. ``texts`` has one binary
    column; ``counts`` comes from ``count_tokens``."""
    sums = counts.agg(F.sum("c"), F.count("*")).first()
    n, v = int(sums[0] or 0), sums[1]
    top = counts.orderBy(F.desc("c"), "token").limit(HEAD).collect()
    forms = counts.groupBy("form").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    mass, kinds = np.zeros(FORM_CLASSES), np.zeros(FORM_CLASSES)
    for r in forms:
        mass[r["form"]], kinds[r["form"]] = r["c"], r["v"]
    for r in top:
        mass[r["form"]] -= r["c"]
        kinds[r["form"]] -= 1
    c = np.zeros(HEAD)
    c[:len(top)] = [r["c"] for r in top]
    by_class = c.reshape(HEAD_CLASSES, CLASS_SIZE)
    tokens = np.array([r["token"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    classes, members = np.zeros((ROWS, CLASSES), np.float32), np.zeros((IN_ROWS, CLASS_SIZE), np.float32)
    classes[0] = np.log(np.concatenate([by_class.sum(axis=1) + 1e-6, mass + kinds + 1]))
    members[:HEAD_CLASSES] = np.log(by_class + 1e-6)
    model = Model(tokens[order], order, np.log10(c + 1), np.log10(mass + kinds + 1), math.log10(n + v + 1), classes, members)
    if not n:
        return model, 0
    spark = texts.sparkSession
    keyed = texts.withColumn("share", F.pmod(F.xxhash64("text"), F.lit(rounds)))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        found = _round(keyed.where(F.col("share") == r).select("text"), shared, RATE / (1 + r)).collect()
        change = {x["block"]: np.frombuffer(x["change"], np.float32) for x in found}
        flat = np.concatenate([model.classes.reshape(-1), model.members.reshape(-1)])
        for b, part in change.items():
            flat[_block(b, len(flat))] += part
        cut = model.classes.size
        model = Model(model.head, model.rank, model.log_count, model.form_mass, model.total,
                      flat[:cut].reshape(ROWS, CLASSES).copy(), flat[cut:].reshape(IN_ROWS, CLASS_SIZE).copy())
    return model, n


def _block(b: int, size: int) -> slice:
    return slice(size * b // BLOCKS, size * (b + 1) // BLOCKS)


def _round(texts: DataFrame, shared, rate: float) -> DataFrame:
    """Averaged changes of one round: (block, change as float32 bytes)."""

    def run(batches):
        m = shared.value
        w, x = m.classes.copy(), m.members.copy()
        wp, xp = np.full(w.shape, DAMP), np.full(x.shape, DAMP)
        ws, xs = np.zeros(len(w)), np.zeros(len(x))
        for _, _, _, t in _runs(batches, 0):
            sym, known = m.symbols(t)
            rows = context(sym, t)
            cls = np.where(known, sym // CLASS_SIZE, sym - HEAD + HEAD_CLASSES)
            for i in range(0, len(sym), BATCH):
                j = slice(i, i + BATCH)
                _step(w, wp, ws, rows[j], cls[j], rate)
                k = np.flatnonzero(known[j]) + i
                if len(k):
                    _step(x, xp, xs, inner(cls[k], rows[k]), sym[k] % CLASS_SIZE, rate)
        seen = np.concatenate([np.repeat(ws, CLASSES), np.repeat(xs, CLASS_SIZE)]).astype(np.float32)
        if not seen.any():
            return
        # changes weighted by how often the task saw their row
        change = np.concatenate([(w - m.classes).reshape(-1), (x - m.members).reshape(-1)])
        own = [_block(b, len(change)) for b in range(BLOCKS)]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array([change[s].astype(np.float16).tobytes() for s in own], pa.binary()),
            pa.array([_seen_rows(seen[s]) for s in own], pa.binary())], ["block", "change", "seen"])

    def average(t: pa.Table) -> pa.Table:
        total, weight = 0.0, 0.0
        for c, s in zip(t.column("change").to_pylist(), t.column("seen").to_pylist()):
            n = _all_seen(s)
            total, weight = total + np.frombuffer(c, np.float16).astype(np.float64) * n, weight + n
        mean = (total / np.maximum(weight, 1)).astype(np.float32)
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "change": pa.array([mean.tobytes()], pa.binary())})

    return texts.mapInArrow(run, "block int, change binary, seen binary").groupBy("block").applyInArrow(
        average, "block int, change binary")


def _seen_rows(seen: np.ndarray) -> bytes:
    """Run lengths of equal neighbours: a block spans few weight rows."""
    cut = np.flatnonzero(np.append(True, seen[1:] != seen[:-1]))
    return np.diff(np.append(cut, len(seen))).astype("<i4").tobytes() + seen[cut].astype("<f4").tobytes()


def _all_seen(raw: bytes) -> np.ndarray:
    half = len(raw) // 2
    return np.repeat(np.frombuffer(raw[half:], "<f4").astype(np.float64), np.frombuffer(raw[:half], "<i4"))


def token_scores(m: Model, t: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token, without the log10(c + 1) of other words: base and model
    log10 probability, whether in the head, and the symbol."""
    sym, known = m.symbols(t)
    rows = context(sym, t)
    cls = np.where(known, sym // CLASS_SIZE, sym - HEAD + HEAD_CLASSES)
    score = np.empty(len(sym))
    for i in range(0, len(sym), BATCH):
        j = slice(i, i + BATCH)
        p = log_softmax(m.classes, rows[j])
        score[j] = p[np.arange(len(p)), cls[j]]
    k = np.flatnonzero(known)
    for i in range(0, len(k), BATCH):
        j = k[i:i + BATCH]
        p = log_softmax(m.members, inner(cls[j], rows[j]))
        score[j] += p[np.arange(len(p)), sym[j] % CLASS_SIZE]
    score /= math.log(10)
    score[~known] -= m.form_mass[t.form[~known]]
    base = np.where(known, m.log_count[np.minimum(sym, HEAD - 1)], 0.0) - m.total
    return base, score, known, sym


def fold(key: Column) -> Column:
    """Rows of this remainder are held out of training."""
    return remainder(key, 7) == 2


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows where ``learn`` holds and score every row.

    Returns id, n_tokens, n_known, train_tokens, base_score and score (sums
    of log10 probabilities over the whole text). A null or empty text is one
    end token, a very long one is scored in one piece, whole. Rows are scored
    one by one, so repeated rows and ids stay;
    other columns are not read; an empty table gives no rows; with nothing
    to learn from every token is unknown.

    The frequent tokens' counts are broadcast (``HEAD`` of them); all other
    words meet their counts in one join on the word's hash.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    texts = docs.where(learn).select(text)
    counts = written(count_tokens(texts), "token-counts")
    model, n = train(texts, counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b, lo, hi, t in _runs(batches, 2):
            size = hi - lo
            base, score_, known, sym = token_scores(m, t)
            sums = [np.bincount(t.row, x, size) for x in (base, score_, known & (m.log_count[np.minimum(sym, HEAD - 1)] > 0))]
            rid = b.column(0).slice(lo, size)
            rids = rid.to_numpy()
            other = np.flatnonzero(~known)
            o = other[np.lexsort((t.token[other], t.row[other]))]
            new = np.ones(len(o), bool)
            new[1:] = (t.token[o[1:]] != t.token[o[:-1]]) | (t.row[o[1:]] != t.row[o[:-1]])
            at = np.flatnonzero(new)
            tf = np.diff(np.append(at, len(o)))
            none = lambda kind: pa.nulls(len(at), kind)
            # a text's own row travels with its words under a hash of its number, with no occurrences
            yield pa.RecordBatch.from_arrays([
                rid, pa.array(mix(rids.view(np.uint64)).view(np.int64)), pa.array(np.zeros(size, np.int32)), b.column(1).slice(lo, size),
                pa.array(np.bincount(t.row, minlength=size)), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2].astype(np.int64))],
                names)
            yield pa.RecordBatch.from_arrays([
                pa.array(rids[t.row[o[at]]]), pa.array(t.token[o[at]].view(np.int64)), pa.array(tf.astype(np.int32)), none(b.schema.field(1).type),
                none(pa.int64()), none(pa.float64()), none(pa.float64()), none(pa.int64())], names)

    names = ["rid", "token", "tf", "id", "n", "base", "score", "known"]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text).mapInArrow(
        run, f"rid long, token long, tf int, id {kind}, n long, base double, score double, known long")
    met = rows.join(counts.select("token", "c"), "token", "left")
    gain = F.col("tf") * F.coalesce(F.log10(F.col("c") + F.lit(1)), F.lit(0.0))
    seen = F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(F.lit(0))
    total = met.groupBy("rid").agg(F.max("id").alias("id"), F.max("n").alias("n"), F.sum("base").alias("base"), F.sum("score").alias("score"),
                                   F.sum("known").alias("known"), F.sum(gain).alias("gain"), F.sum(seen).alias("seen"))
    return total.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), (F.col("known") + F.col("seen")).alias("n_known"),
                        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.col("gain")).alias("base_score"),
                        (F.col("score") + F.col("gain")).alias("score"))
