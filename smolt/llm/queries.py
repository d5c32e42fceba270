"""Queries over the given tables, one for each operator, with SQL where SQL
can express the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smolt.llm import collocations, language, maxent, merkle, packing, pieces, quality, sharding, simhash, subspaces, suffixes, topk, toxicity
from smolt.llm.common import documents, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@query("op1_maxent")
def op1_maxent(spark, d):
    found = maxent.score(documents(spark, d), ~maxent.fold(F.col("doc_id")))
    return found.select("doc_id", maxent.fold(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                        "base_score", "score")


@query("op2_toxicity")
def op2_toxicity(spark, d):
    docs = documents(spark, d).select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels, ~toxicity.fold(F.col("doc_id")))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.fold(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


@query("op3_language_id")
def op3_language_id(spark, d):
    docs = documents(spark, d)
    model = language.train(docs, ~language.fold(F.col("doc_id")))
    return language.predict(docs, model).select(
        "doc_id", language.fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


_STOP = ", ".join(f"'{w}'" for w in sorted({w for ws in quality.STOP_WORDS.values() for w in ws}))
QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(t, '!')) AS n_shouts,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(covered.n, 0) AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS n_stop FROM w LEFT JOIN covered USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.1 * n_words OR n_shouts > 0.3 * n_words OR word_chars < 2 * n_words
            OR word_chars > 20 * n_words OR n_dup_lines > 0.5 * n_lines OR n_stop < 0.01 * n_words) AS kept
FROM v"""


@query("op4_quality_rules", QUALITY_SQL)
def op4_quality_rules(spark, d):
    q = F.col("quality")
    return quality.score_quality(documents(spark, d).select("doc_id", "text")).select(
        "doc_id", *[q[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        ((q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])).alias("base_failed"),
        q["kept"].alias("kept"))


@query("op5_pieces")
def op5_pieces(spark, d):
    from public_tokenizers import path
    model = path("piece_bpe_32k.model")
    docs = documents(spark, d).select("doc_id", "text")
    # the text's checksum is carried beside the ids, so the round trip is checked row by row
    rows = pieces.encode(docs, model, carry={"text_crc32": F.crc32(F.col("text").cast("binary"))})
    return pieces.decode(rows, model).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"), F.crc32(F.col("text").cast("binary")).eqNullSafe(F.col("text_crc32")).alias("lossless"))


TOP_K_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


@query("op6_cover_tree_topk", TOP_K_SQL)
def op6_cover_tree_topk(spark, d):
    prepare(spark)
    return topk.top_k(spark.read.parquet(f"{d}/embeddings.parquet"), F.col("id") % 100 == 0, k=10)


@query("op7_packing")
def op7_packing(spark, d):
    from public_tokenizers import path
    p = packing.pack(documents(spark, d), path("word_bpe_49k.json"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_histogram_sharding")
def op8_histogram_sharding(spark, d):
    return sharding.histogram_shards(documents(spark, d), shards=40, carry=["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


# all windows of 50 words, without suffixes: independent of the operator
PASSAGES_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS s FROM d WHERE len(ws) >= 50),
w AS (SELECT doc_id, s, md5(array_to_string(ws[s + 1:s + 50], ' ')) AS g FROM p),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1 AS earlier, count(*) OVER (PARTITION BY g) AS n FROM w),
t AS (SELECT doc_id, s, earlier FROM r WHERE n > 1),
i AS (SELECT doc_id, s, earlier, sum(CASE WHEN s - q <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island
      FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS q FROM t)),
c AS (SELECT doc_id, island, count(DISTINCT j) AS n FROM (SELECT doc_id, island, unnest(range(s, s + 50)) AS j FROM i WHERE earlier) GROUP BY doc_id, island)
SELECT doc_id, min(s)::INTEGER AS start, (max(s) + 50 - min(s))::INTEGER AS length, coalesce(any_value(c.n), 0)::BIGINT AS cut_words
FROM i LEFT JOIN c USING (doc_id, island) GROUP BY doc_id, island"""


@query("op9_suffix_dedup", PASSAGES_SQL)
def op9_suffix_dedup(spark, d):
    """One row per repeated span (in words); cut_words of it occur earlier."""
    found = suffixes.passages(documents(spark, d)).select(F.col("id").alias("doc_id"), F.explode("spans").alias("s"), "cuts")
    end = lambda x: x["start"] + x["length"]
    cut = F.aggregate("cuts", F.lit(0).cast("long"), lambda n, c: n + F.greatest(
        F.lit(0), F.least(end(c), end(F.col("s"))) - F.greatest(c["start"], F.col("s")["start"])))
    return found.select("doc_id", F.col("s.start").alias("start"), F.col("s.length").alias("length"), cut.alias("cut_words"))


@query("op10_simhash")
def op10_simhash(spark, d):
    return simhash.simhash_components(documents(spark, d), shingle=4, budget=4).select(
        "doc_id", "fingerprint", F.col("component").alias("component_id"))


# all pairs of a label
NEAR_VECTORS_SQL = """
WITH RECURSIVE r AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
e AS (SELECT * FROM r WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(v, lambda x: x <> 0)) > 0),
k AS (SELECT a.rid, b.rid AS other, b.vec_id FROM e a JOIN e b ON a.label = b.label AND a.rid <> b.rid AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
w AS (SELECT rid, rid AS other FROM r UNION SELECT w.rid, k.other FROM w JOIN k ON k.rid = w.other),
c AS (SELECT w.rid, min(r.vec_id) AS component_id FROM w JOIN r ON r.rid = w.other GROUP BY w.rid)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM r JOIN c USING (rid) LEFT JOIN (SELECT rid, count(*) AS n FROM k GROUP BY rid) USING (rid)"""


@query("op11_subspaces", NEAR_VECTORS_SQL)
def op11_subspaces(spark, d):
    prepare(spark)
    found = subspaces.near_duplicates(spark.read.parquet(f"{d}/embeddings.parquet"), 0.93)
    return found.select(F.col("id").alias("vec_id"), F.col("links").alias("n_links"), F.col("component").alias("component_id"),
                        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


# level by level, one recursive step each; crc32 bit by bit
MERKLE_SQL = r"""
WITH RECURSIVE l AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, n_chars,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS tail,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
          lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295) % 7 = 0 AS tampered FROM documents),
h AS (SELECT *, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
  sha256(head || coalesce(strlen((n_chars + CASE WHEN tampered THEN 1 ELSE 0 END)::VARCHAR) || ':' || (n_chars + CASE WHEN tampered THEN 1 ELSE 0 END), '-') || tail) AS held FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM h),
node AS (SELECT g, 0 AS h, pos, n, leaf AS d FROM o
  UNION ALL SELECT g, h + 1, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY g, h, pos // 2, n),
sub AS (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
top AS (SELECT 0 AS h, pos, n, d FROM sub
  UNION ALL SELECT h + 1, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY h, pos // 2, n),
way AS (SELECT doc_id, leaf, g, 0 AS h, pos, n, pos AS own, held AS fold, '' AS proof FROM o
  UNION ALL SELECT w.doc_id, w.leaf, w.g, w.h + 1, w.pos // 2, (w.n + 1) // 2, own,
    sha256(CASE WHEN w.pos % 2 = 1 THEN s.d || fold ELSE fold || coalesce(s.d, '') END), proof || coalesce(s.d, '')
  FROM way w LEFT JOIN node s ON s.g = w.g AND s.h = w.h AND s.pos = xor(w.pos, 1) WHERE w.n > 1),
up AS (SELECT w.doc_id, w.leaf, w.g, 0 AS h, s.pos, s.n, own, fold, proof, s.d AS subroot FROM way w JOIN sub s USING (g) WHERE w.n = 1
  UNION ALL SELECT u.doc_id, u.leaf, u.g, u.h + 1, u.pos // 2, (u.n + 1) // 2, own,
    sha256(CASE WHEN u.pos % 2 = 1 THEN s.d || fold ELSE fold || coalesce(s.d, '') END), proof || coalesce(s.d, ''), subroot
  FROM up u LEFT JOIN top s ON s.h = u.h AND s.pos = xor(u.pos, 1) WHERE u.n > 1)
SELECT doc_id, leaf, subroot, (SELECT d FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
       fold = (SELECT d FROM top WHERE n = 1) AS verified FROM up WHERE n = 1"""


@query("op12_merkle", MERKLE_SQL)
def op12_merkle(spark, d):
    docs = documents(spark, d)
    cols = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    held = merkle.leaf(*{**cols, "n_chars": F.col("n_chars") + 1}.values())
    found = merkle.manifest(docs, merkle.leaf(*cols.values()), cols["lang"], cols["doc_id"], F.when(tampered, held))
    text = lambda c: F.lower(F.hex(c))
    return found.select(F.col("key").alias("doc_id"), *[text(c).alias(c) for c in ("leaf", "subroot", "root")],
                        F.sha2(text("siblings"), 256).alias("proof_sha256"), text("folded").alias("folded_root"),
                        (F.col("folded") == F.col("root")).alias("verified"))


# phrases of one to three words counted by themselves; products in 128 bits
PHRASE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f1 AS (SELECT lang, w1, count(*) AS a FROM (SELECT lang, unnest(w) AS w1 FROM q) GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS a FROM (SELECT lang, w[i] AS w1, w[i + 1] AS w2 FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM q))
       GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS a FROM (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3
         FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM q)) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.a, 1 AS k, x.a AS l, y.a AS r FROM f2
        JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
        WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w1 = f2.w1 AND f3.w2 = f2.w2 AND 100 * f3.a >= 50 * f2.a)
          AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w2 = f2.w1 AND f3.w3 = f2.w2 AND 100 * f3.a >= 50 * f2.a)
      UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.a, 1, x.a, y.a FROM f3
        JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
      UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.a, 2, x.a, y.a FROM f3
        JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
s AS (SELECT *, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM c),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM o JOIN (SELECT lang, sum(a) AS n FROM f1 GROUP BY lang) USING (lang) WHERE rank <= 2000"""


@query("op13_collocations", PHRASE_SQL)
def op13_collocations(spark, d):
    return collocations.mine(documents(spark, d), F.col("text"), F.col("lang")).withColumnRenamed("g", "lang")
