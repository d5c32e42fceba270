"""Sharding by histogram sort (DataFrame functions only).

Rows are sorted on a content key and cut into shards of near equal bytes.
The cuts are found without sorting: each round counts the exact bytes and
rows of every key bucket (one partial aggregate over all rows), locates
the buckets that hold a cut's target, and probes inside only those with
longer key prefixes, until every cut is within its tolerance or falls
between single rows. Only bucket totals reach the driver, at most
``PROBES`` a round, whatever the input. The rows then move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smolt.llm.common import written

#: Candidate boundaries that one round counts, over all open cuts.
PROBES = 65_536
#: Most key ranges (shards times cells) that one search looks for.
RANGES = 4_096


def _hex(c: Column) -> Column:
    return F.lpad(F.hex(c), 16, "0")


def content_key(text: Column, row_id: Column) -> Column:
    """48 hex digits, in order of: hash of the text (equal texts are
    neighbours), hash of the id, row number in the written table (so equal
    rows have different keys and a group of them can be cut anywhere)."""
    return F.concat(_hex(F.xxhash64(F.coalesce(text, F.lit("")))), _hex(F.xxhash64(row_id)),
                    _hex(F.monotonically_increasing_id()))


def _common(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _pick(key: Column, bounds: list[str], lo: int = 0, hi: int | None = None) -> Column:
    """How many bounds are <= key: a balanced tree of comparisons."""
    hi = len(bounds) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(key < F.lit(bounds[mid]), _pick(key, bounds, lo, mid)).otherwise(_pick(key, bounds, mid + 1, hi))


def splitters(rows: DataFrame, targets: list[float], slack: list[float]) -> list[str]:
    """Keys at which the byte counts below come nearest to ``targets``
    (ascending); ``rows`` has key and size.

    The cut for target t is settled when the bucket holding t has at most
    ``slack`` bytes or a single row; the nearer end of that bucket becomes
    the cut.
    """
    cuts: dict[int, str] = {}
    open_: dict[str, tuple[int, list[int]]] = {"": (0, list(range(len(targets))))} if targets else {}
    key = F.col("key")
    while open_:
        step = next(s for s in (3, 2, 1) if s == 1 or len(open_) * 16 ** s <= PROBES)
        inside = probe = F.lit(None).cast("string")
        for n in sorted({len(p) for p in open_}):
            head = F.substring(key, 1, n) if n else F.lit("")
            here = head.isin([p for p in open_ if len(p) == n])
            inside, probe = F.when(here, head).otherwise(inside), F.when(here, F.substring(key, 1, n + step)).otherwise(probe)
        found = (rows.select(inside.alias("p"), probe.alias("probe"), "key", "size").where("p IS NOT NULL")
                 .groupBy("p", "probe").agg(F.sum("size").alias("b"), F.count("*").alias("n"),
                                            F.min("key").alias("lo"), F.max("key").alias("hi")).collect())
        buckets: dict[str, list] = {}
        for r in sorted(found, key=lambda r: r["lo"]):
            buckets.setdefault(r["p"], []).append(r)
        later: dict[str, tuple[int, list[int]]] = {}
        for p, (below, wanted) in open_.items():
            own, k = buckets[p], 0
            for i in wanted:
                while k < len(own) - 1 and below + own[k]["b"] < targets[i]:
                    below += own[k]["b"]
                    k += 1
                r = own[k]
                if r["b"] <= slack[i] or r["n"] == 1:
                    cuts[i] = r["lo"] if targets[i] - below <= below + r["b"] - targets[i] else r["hi"] + "~"
                else:
                    q = r["lo"][:max(_common(r["lo"], r["hi"]), len(r["probe"]))]
                    later.setdefault(q, (below, []))[1].append(i)
        open_ = later
    return [cuts[i] for i in range(len(targets))]


def histogram_shards(docs: DataFrame, shards: int = 40, tolerance: float = 0.001, id_col: str = "doc_id",
                     text_col: str = "text", carry: list[str] | None = None,
                     cell_rows: int = 50_000) -> DataFrame:
    """Every row of ``docs`` with its shard, under the law ``bytes``: shards
    are consecutive key ranges whose summed sizes are near equal.

    ``carry`` names the columns to move (all by default). Added: size
    (UTF-8 bytes of the text plus 16), text_crc32, shard, slot (gapless
    from 0 in each shard, in key order). Added columns replace input
    columns of the same name. A null text has no bytes and checksum 0; a
    text longer than a shard's share makes its shard larger; a null id is a key like any other; equal rows stay as many as they are
    and may fall to different shards; an empty table gives no rows. Shards
    can be empty when there are fewer rows than shards.

    The keyed rows are written once to the shared folder, so every round
    and the exchange see the same keys. No task sorts a whole shard: the
    same search cuts a shard into cells of about ``cell_rows`` rows (at
    most ``RANGES`` cells in all), and the slots of a cell begin at the
    count of rows in the shard's cells before it.
    """
    text = F.col(text_col).cast("string")
    added = {"size", "text_crc32", "shard", "slot", "key", "cell", "first"}
    cols = [c for c in (docs.columns if carry is None else carry) if c.lower() not in added]
    data = F.coalesce(text, F.lit(""))
    rows = written(docs.select(
        *[F.col(c) for c in cols], (F.octet_length(data) + F.lit(16)).cast("long").alias("size"),
        F.crc32(data.cast("binary")).alias("text_crc32"), content_key(text, F.col(id_col)).alias("key")), "shard-rows")
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    cells = max(1, min(RANGES // shards, -(-n // (shards * cell_rows))))
    ranges = shards * cells
    targets = [total * i / ranges for i in range(1, ranges)] if n else []
    slack = [(tolerance if i % cells == 0 else 0.5 / cells) * (total or 0) / shards for i in range(1, ranges)]
    cuts = splitters(rows.select("key", "size"), targets, slack)
    # neighbouring cuts settled in different rounds can cross by less than their slack
    cuts = sorted(cuts)
    rows = rows.withColumn("cell", _pick(F.col("key"), cuts).cast("int"))
    counts = rows.groupBy("cell").agg(F.count("*").alias("n"))
    shard = F.floor(F.col("cell") / F.lit(cells)).cast("int")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (counts.withColumn("shard", shard)
              .select("cell", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    own = Window.partitionBy("cell").orderBy("key")
    return (rows.withColumn("slot", F.row_number().over(own) - F.lit(1)).join(F.broadcast(firsts), "cell")
            .select(*cols, "size", "text_crc32", "shard", (F.col("slot") + F.col("first")).cast("long").alias("slot")))
