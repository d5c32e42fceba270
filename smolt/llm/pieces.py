"""Sampled SentencePiece segmentations, and lossless decoding.

A text is a lattice whose edges are vocabulary pieces. A segmentation is
drawn by forward filtering (the total weight of all ways to reach each
position) and backward sampling (from the end, each piece in proportion to
its weight times the total before it). The random number of a position is
a hash of the row's seed and the position, so a row always gets the same
draw. No piece crosses from a word into the blanks after it, so the lattice
falls into units (blanks and the word behind them); the distinct units of a
batch are filtered together, and all their occurrences sampled together.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smolt.llm.packing import chunks
from smolt.llm.tokens import BASE, inverse, mix, powers

#: Units longer than this, or with more characters without a piece, are filtered one by one in the log domain.
LONG, STRANGE = 32, 4
#: Weight per character that keeps sums of a short unit in the range of a double.
LIFT = 1e3


class Pieces:
    """Lattice weights and surfaces of a model file.

    A piece of rank r (its merge order) weighs (r + 1) ** -power, Zipf's
    law, since a merge-ranked vocabulary holds no probabilities. Blanks are
    taken as they are (no normalization, no blank added in front); a
    character without a piece becomes the pieces of its bytes.
    """

    def __init__(self, path: str, power: float):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.logp: dict[str, tuple[float, tuple[int, ...]]] = {}
        self.surface: list[bytes] = []
        bytes_: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            text = sp.id_to_piece(i)
            raw = b""
            if sp.is_byte(i):
                bytes_[int(text[3:5], 16)] = i
                raw = bytes([int(text[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                key = text.replace("▁", " ")
                raw = key.encode()
                if " " in key.lstrip(" ") or "\n" in key and key != "\n":
                    raise ValueError("a piece crosses units")
                self.logp[key] = (-power * math.log1p(-sp.get_score(i)), (i,))
            self.surface.append(raw)
        low = min((p for p, _ in self.logp.values()), default=-power)
        self.bytes = {b: (low, (i,)) for b, i in bytes_.items()}
        self.longest = max(map(len, self.logp), default=1)
        # for each length: sorted hashes of the pieces, their weights and ids
        self.by_length = []
        for n in range(1, self.longest + 1):
            keys = [k for k in self.logp if len(k) == n]
            h = Prefix(_codes(keys)).hashes(np.arange(len(keys)) * n, n)
            order = np.argsort(h)
            weight = np.exp(np.array([self.logp[k][0] for k in keys])) * LIFT ** n
            self.by_length.append((h[order], weight[order], np.array([self.logp[k][1][0] for k in keys], np.int64)[order]))

    def character(self, c: str) -> tuple[float, tuple[int, ...]]:
        """A character without a piece, as one edge of byte pieces."""
        parts = [self.bytes[b] for b in c.encode()]
        return sum(p for p, _ in parts), tuple(i for _, ids in parts for i in ids)

    def edges(self, unit: str, end: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """All pieces that end at ``end``: (start, log weight, ids), shortest first."""
        out = []
        for start in range(end - 1, max(0, end - self.longest) - 1, -1):
            e = self.logp.get(unit[start:end])
            if e is not None:
                out.append((start, *e))
            elif start == end - 1:
                out.append((start, *self.character(unit[start])))
        return out

    def sample(self, unit: str, draw: Callable[[int], float]) -> list[tuple[int, tuple[int, ...]]]:
        """One unit in the log domain: (end, ids) of its sampled pieces, last
        first; ``draw`` gives the random number of an end position."""
        total, table = [0.0], []
        for end in range(1, len(unit) + 1):
            e = self.edges(unit, end)
            w = [total[s] + p for s, p, _ in e]
            top, cum = max(w), []
            for x in w:
                cum.append((cum[-1] if cum else 0.0) + math.exp(x - top))
            total.append(top + math.log(cum[-1]))
            table.append((cum, e))
        out, end = [], len(unit)
        while end:
            cum, e = table[end - 1]
            start, _, ids = e[bisect_right(cum, draw(end) * cum[-1], 0, len(cum) - 1)]
            out.append((end, ids))
            end = start
        return out


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Prefix:
    """Hashes of substrings of a code point array, from its prefix sums."""

    def __init__(self, codes: np.ndarray):
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes + np.uint64(1)) * powers(BASE, len(codes)), out=self.sums[1:])
        self.back = powers(inverse(BASE), len(codes) + 1)

    def hashes(self, at: np.ndarray, n) -> np.ndarray:
        """Of the n code points from each position."""
        return mix((self.sums[at + n] - self.sums[at]) * self.back[at] + np.asarray(n).astype(np.uint64))


def draws(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) of places in rows."""
    return (mix(seed ^ mix(place.astype(np.uint64) + np.uint64(1))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def sample_batch(pieces: Pieces, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
    """Sampled ids of each text."""
    codes = _codes(texts)
    ends = np.cumsum([0, *map(len, texts)])
    if not len(codes):
        return [np.zeros(0, np.int64) for _ in texts]
    blank, line = codes == 32, codes == 10
    cut = np.ones(len(codes), bool)
    cut[1:] = line[1:] | line[:-1] | (blank[1:] & ~blank[:-1])
    cut[ends[:-1][ends[:-1] < len(codes)]] = True
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, len(codes)))
    row = np.searchsorted(ends, start, "right") - 1
    prefix = Prefix(codes)
    _, first, same = np.unique(prefix.hashes(start, size), return_index=True, return_inverse=True)
    # Characters of the distinct short units, longest unit first, all first
    # characters, then all second ones, and so on: the units that have an
    # o-th character are rank 0..count[o]-1, at column[o] + rank.
    n = size[first]
    short = np.flatnonzero(n <= LONG)
    order = short[np.argsort(-n[short], kind="stable")]
    rank = np.full(len(n), -1)
    rank[order] = np.arange(len(order))
    n = n[order]
    count = [int(np.searchsorted(-n, -o, "right")) for o in range(1, LONG + 2)]
    column = np.cumsum([0, *count])
    begin = start[first][order]
    at = np.concatenate([begin[:c] + o for o, c in enumerate(count)])
    left = np.concatenate([n[:c] - o for o, c in enumerate(count)])
    value = np.zeros((pieces.longest, len(at)))  # [length - 1, start]
    ident = np.full((pieces.longest, len(at)), -1, np.int32)
    for k, (h, w, ids) in enumerate(pieces.by_length):
        if not len(h):
            continue
        own = np.flatnonzero(left > k)
        x = prefix.hashes(at[own], k + 1)
        j = np.searchsorted(h, x)
        j[j == len(h)] = 0
        hit = h[j] == x
        value[k, own[hit]], ident[k, own[hit]] = w[j[hit]], ids[j[hit]]
    none = np.flatnonzero(ident[0] < 0)
    kinds, kind = np.unique(codes[at[none]], return_inverse=True)
    lone = [pieces.character(chr(c)) for c in kinds.tolist()]
    if len(none):
        value[0, none] = np.array([math.exp(p) for p, _ in lone])[kind] * LIFT
        ident[0, none] = -2 - kind.astype(np.int32)
    of_rank = np.concatenate([np.arange(c) for c in count])
    strange = np.bincount(of_rank[none], minlength=len(order)) > STRANGE
    # forward: total weight up to each end, all units at once; ``ways`` are
    # the running totals over the length of the last piece, by its last character
    total = [np.ones(len(order))]
    ways = np.zeros((pieces.longest, len(at)))
    for o, c in enumerate(count):
        last, run = slice(column[o], column[o] + c), 0.0
        for k in range(pieces.longest):
            if k <= o:
                run = run + total[o - k][:c] * value[k, column[o - k]:column[o - k] + c]
            ways[k, last] = run
        total.append(run)
    ways = np.ascontiguousarray(ways.T)
    # backward: one piece of every unit's occurrence a step
    out = np.full(len(codes) + 1, -1, np.int64)
    rank = rank[same]
    slow = (rank < 0) | (strange[rank] if len(strange) else True)
    occ = np.flatnonzero(~slow)
    rank, end, seed, base = rank[occ], size[occ], seeds[row[occ]], start[occ]
    shift = base - ends[row[occ]]
    while len(end):
        w = ways[column[end - 1] + rank]
        r = draws(seed, shift + end) * w[:, -1]
        k = (w <= r[:, None]).sum(axis=1)
        here = end - 1 - k
        out[base + end] = ident[k, column[here] + rank]
        go = here > 0
        end, rank, seed, base, shift = here[go], rank[go], seed[go], base[go], shift[go]
    extra: list[tuple[int, ...]] = [ids for _, ids in lone]
    for i in np.flatnonzero(slow).tolist():
        text = codes[start[i]:start[i] + size[i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        own, from_, shift = seeds[row[i]:row[i] + 1], int(start[i]), int(start[i] - ends[row[i]])
        for e, ids in pieces.sample(text, lambda e, own=own, shift=shift: float(draws(own, np.array([shift + e]))[0])):
            out[from_ + e] = -2 - len(extra)
            extra.append(ids)
    place = np.flatnonzero(out != -1)
    ids = out[place]
    many = np.where(ids < 0, np.array([len(x) for x in extra] or [1])[np.maximum(-2 - ids, 0)], 1)
    flat = np.repeat(ids, many)
    wide = np.flatnonzero(ids < 0)
    if len(wide):
        flat[flat < 0] = np.concatenate([np.array(extra[-2 - i]) for i in ids[wide]])
    edge = np.concatenate(([0], np.cumsum(many)))[np.searchsorted(place, ends, "right")]
    return [flat[a:b] for a, b in zip(edge[:-1], edge[1:])]


_loaded: dict[tuple, Pieces] = {}


def load(path: str, power: float) -> Pieces:
    if (path, power) not in _loaded:
        _loaded[path, power] = Pieces(path, power)
    return _loaded[path, power]


def encode(docs: DataFrame, model_file: str, power: float = 1.0, seed: int = 0, id_col: str = "doc_id",
           text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, ids) of every row, and the columns of ``carry``: one sampled segmentation of the whole text,
    as unsigned 32-bit little-endian ids.

    The draw depends on ``seed``, the id and the text alone, not on the
    partitioning; rows of equal id and text get equal draws. A null text
    gives null ids, an empty one no ids, a very long one all of its pieces in
    one row. A null id is a key like any other.
    Other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_file, power)
        for b in batches:
            texts, seeds = b.column(2).to_pylist(), b.column(1).to_numpy().view(np.uint64)
            for lo, hi in chunks([t or "" for t in texts], 1 << 18):
                found = sample_batch(pieces, [t or "" for t in texts[lo:hi]], seeds[lo:hi])
                ids = [None if t is None else x.astype("<u4").tobytes() for t, x in zip(texts[lo:hi], found)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary()),
                                                  *(b.column(i).slice(lo, hi - lo) for i in range(3, b.num_columns))], names)

    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))
    rows = docs.select(F.col(id_col), key.alias("_seed"), F.col(text_col).cast("string").alias("_text"),
                       *(c.alias(n) for n, c in (carry or {}).items()))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [id_col, "ids", *(carry or {})]
    return rows.mapInArrow(run, ", ".join(f"`{n}` {'binary' if n == 'ids' else kinds[n]}" for n in names))


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``encoded`` with a column ``out``: the exact text of its ids (null
    for null). Other columns pass unchanged."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def joined(ids: pa.Array) -> pa.Array:
        surface = load(model_file, 1.0).surface
        return pa.array([None if x is None else b"".join([surface[i] for i in np.frombuffer(x, "<u4").tolist()]).decode()
                         for x in ids.to_pylist()], pa.string())

    return encoded.withColumn(out, joined(F.col(ids_col)))
