"""Packing by concatenate-and-cut.

Pass 1 tokenizes every document and writes its ids with the running token
offset inside its task's partition. The prefix sum over the partitions'
token totals (one row per partition) gives every document its global
offset. Pass 2 cuts the ids at multiples of the window; a document that
crosses a cut leaves a boundary record in each sequence it touches. No
rows move between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from smolt.llm.common import written

#: Tokens of a full sequence, and the id that ends each document.
WINDOW, END_ID = 2048, 1
#: Words whose ids one worker remembers.
REMEMBERED = 800_000
#: Bytes of text tokenized at a time.
CHUNK = 1 << 20


def _plain(text: str) -> bool:
    """Letters alone, all below those whose lower case takes two characters."""
    return text.isalpha() and max(text) < "İ"


class WordIds:
    """Ids of a text as the joined ids of its ASCII-space separated words.

    Holds for tokenizers that drop white space and never merge across it.
    Equal words are encoded once: words of letters (and closing
    punctuation) are encoded many at a time in one joined text, where each
    word ends with an id whose token has the word-end suffix; any other
    word is encoded alone.
    """

    def __init__(self, path: str, suffix: str = "</w>"):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 65_536 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}

    def _alone(self, words: list[bytes]) -> None:
        got = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        for w, e in zip(words, got):
            self.known[w] = np.array(e.ids, self.dtype).tobytes()

    def _letters(self, words: list[bytes]) -> None:
        for k in range(0, len(words), 1000):
            part = words[k:k + 1000]
            got = self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)
            ids = np.array(got[0].ids, self.dtype)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(part) or cut[-1] != len(ids):
                self._alone(part)
                continue
            raw, size = ids.tobytes(), self.dtype.itemsize
            for w, a, b in zip(part, [0, *cut[:-1].tolist()], cut.tolist()):
                self.known[w] = raw[a * size:b * size]

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        known, letters, alone, tails = self.known, set(), [], []
        for w in words.difference(known):
            core = w.rstrip(b".,;:!?")
            if core.isalpha() or _plain(core.decode("utf-8", "replace")):
                if core not in known:
                    letters.add(core)
                if core != w:
                    tails.append((w, core, w[len(core):]))
            else:
                alone.append(w)
        marks = {m for _, _, m in tails if m not in known}
        self._letters(list(letters))
        self._alone([*alone, *marks])
        for w, core, m in tails:
            known[w] = known[core] + known[m]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.lower().split() for t in texts]
        self.learn(set().union(*split))
        ids = self.known.__getitem__
        return [b"".join(map(ids, ws)) for ws in split]


_workers: dict[str, WordIds] = {}


def _encoder(path: str) -> WordIds:
    """One encoder for a worker process: later tasks find its words known."""
    if path not in _workers:
        _workers[path] = WordIds(path)
    return _workers[path]


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive runs of texts with about ``most`` bytes (one at least)."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def tokenized(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass 1, written to the shared folder: pid, doc_id, local (tokens of
    the partition before the document), n (its tokens with the end id),
    width (bytes of an id) and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pid, local = _encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], words.dtype).tobytes()
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                ids = [x + end for x in words.encode(texts[lo:hi])]
                n = np.array([len(x) for x in ids], np.int64) // words.dtype.itemsize
                at = local + np.cumsum(n) - n
                local += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(hi - lo, pid, np.int32)), b.column(0).slice(lo, hi - lo), pa.array(at), pa.array(n),
                     pa.array(np.full(hi - lo, words.dtype.itemsize, np.int32)), pa.array(ids, pa.binary())],
                    ["pid", "doc_id", "local", "n", "width", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(
        run, f"pid int, doc_id {kind}, local long, n long, width int, ids binary")
    return written(rows, "packing-tokens")


def pieces(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pass 2: rows of ``tokenized`` cut into windows (see ``pack``)."""
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = tokens.groupBy("pid").agg(F.sum("n").alias("total")).select(
        "pid", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n, width = (b.column(i).to_numpy() for i in (1, 2, 3))
            texts = b.column(4)
            for lo, hi in chunks([range(int(x) * 4) for x in n]):  # 4 bytes an id
                first, last = at[lo:hi] // window, (at[lo:hi] + n[lo:hi] - 1) // window
                many = last - first + 1
                row = np.repeat(np.arange(lo, hi), many)
                seq = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                begin = np.maximum(seq * window, at[row])
                start, length = begin - at[row], np.minimum((seq + 1) * window, at[row] + n[row]) - begin
                ids, cut = [], {}
                for r, s, k in zip(row.tolist(), start.tolist(), length.tolist()):
                    if r not in cut:
                        cut = {r: np.frombuffer(texts[r].as_py(), f"<u{width[r]}").astype("<u4")}
                    ids.append(cut[r][s:s + k].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(n[row]), pa.array(seq),
                     pa.array(begin - seq * window), pa.array(ids, pa.binary())],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    placed = tokens.join(F.broadcast(bases), "pid")  # one row for each task of pass 1
    return placed.select("doc_id", (F.col("local") + F.col("base")).alias("at"), "n", "width", "ids").mapInArrow(
        run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of ``window`` tokens.

    Returns one row per piece: doc_id, start (the document's ids before
    it), length, doc_tokens (with the end id), sequence_id, offset in the
    sequence, and ids (unsigned 32-bit, little-endian). All sequences are
    full but the last. A null or empty text is one end id, a very long one
    runs through as many sequences as it fills; null and
    repeated ids are carried as they are (each row is packed by itself);
    an empty table gives no rows; other columns are not read.
    """
    return pieces(tokenized(docs, vocabulary, id_col, text_col), window)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id and ids, pieces joined in
    order (at most ``window`` ids meet in one group)."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.aggregate(F.transform("p", lambda x: x["ids"]), F.lit(b""),
                                                  lambda a, x: F.concat(a, x)).alias("ids"))
