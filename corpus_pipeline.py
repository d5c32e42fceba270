"""Corpus pipeline over the documents table.

Stages, in order: quality rules (rejected documents go), toxicity (rejected
documents go), SimHash near-duplicates (one document of each class stays),
repeated passages (cut but where they occur first), packing. Each stage
reads what the one before it kept and wrote; all but the last return the
columns of their input, whatever their names. An empty table passes every
stage and packs into no piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smolt.llm import packing, quality, simhash, suffixes, toxicity
from smolt.llm.common import fresh, prepare, written

#: Bits by which near-duplicates may differ, words of a shingle, words of a repeated passage.
BITS, SHINGLE, PASSAGE = 4, 4, 50


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the production table rejects. Null and empty
    texts have too few words and go; repeated rows are judged alike."""
    verdict, = fresh(docs, "_quality")
    return quality.score_quality(docs, out=verdict).where(F.col(verdict)["kept"]).drop(verdict)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below 0.5, with a model learnt
    from the labelled ones among ``docs``. Null and empty texts stay, very
    long ones are restored whole, repeated rows are judged alike."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, ~toxicity.fold(F.col("doc_id")))
    score, = fresh(docs, "_toxicity")
    return toxicity.score(docs, model, out=score).where(F.col(score) < 0.5).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash class (null ids
    last, then the first row). Texts without a word are one class; very long
    ones count with all their shingles."""
    prepare(spark)
    return simhash.keep_one(docs, SHINGLE, BITS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with passages of 50 words or more cut wherever they
    occur a second time; n_chars counts the text that is left. Null, empty
    and short texts stay as they are, very long ones are read whole."""
    prepare(spark)
    return suffixes.remove_repeats(docs, PASSAGE, chars_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences of 2048 tokens, with their ids. A null or
    empty text is one end id, a very long one fills many sequences."""
    from public_tokenizers import path
    prepare(spark)
    return packing.pack(docs, path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", pack),
]

#: No SQL: viterbi decoding, XXH64 fingerprints and the tokenizer have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage but the last is
    written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
