"""A corpus pipeline over `documents`: language ID, near duplicates, substring dedup, decontamination, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and reread as the next one's docs. All but
the last return the columns of documents; columns beside those are dropped. Rows with one id are one document: they stay
or go together. Rows without an id are documents by text: equal texts are one document, of which one row stays, and they
come after all others wherever a smallest id decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm.common import doc_crc, in_own_session, table
from veristrata.llm.decontaminate import find_leaks
from veristrata.llm.jaccard import jaccard_components
from veristrata.llm.langid import UNKNOWN, predict_languages, train_language_model
from veristrata.llm.packing import pack_documents
from veristrata.llm.substring import dedup_words
from veristrata.plans.checkpoint import discard, store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids that stand for null ones are at least this.
NAMELESS = 1 << 61


def _named(docs: DataFrame) -> DataFrame:
    """COLUMNS with `own`, an id that is never null: that of the row, or one of its text."""
    docs = in_own_session(docs).select(*COLUMNS)
    by_text = F.lit(NAMELESS) + F.pmod(F.xxhash64("text"), F.lit(NAMELESS))
    named = docs.where("doc_id is not null").withColumn("own", F.col("doc_id").cast("long"))
    return named.unionAll(docs.where("doc_id is null").dropDuplicates(["text"]).withColumn("own", by_text))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (null, or no letter in them) go."""
    docs = in_own_session(docs)
    model = train_language_model(docs, F.pmod(doc_crc(), F.lit(3)) == 1)
    return predict_languages(docs.select(*COLUMNS), model).where(F.col("lang_pred") != UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    docs = _named(docs)
    gone = jaccard_components(docs.select(F.col("own").alias("doc_id"), "text")).where("doc_id <> component_id").select(F.col("doc_id").alias("own"))
    return docs.join(gone, "own", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 50 that a document with a smaller id has go; documents that lose all their words go."""
    texts = _named(docs).select(F.col("own").alias("doc_id"), "text", F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    done = dedup_words(texts, texts=True, keep=["id", "lang", "source", "n_chars"]).where("n_removed = 0 OR n_removed < n_words")
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return done.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def leaked_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    docs = _named(docs)
    leaks = find_leaks(docs.select(F.col("own").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("own")).distinct()
    return docs.join(leaks, "own", "left_anti").select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 4096 tokens."""
    import public_tokenizers

    return pack_documents(in_own_session(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("leaked_benchmarks", leaked_benchmarks),
    ("packed_sequences", packed_sequences),
]

#: SQL can't express the models of language ID and latent retrieval, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store(docs, name)
            if last is not None:
                discard(last)  # the table that this stage has read
            last = docs
    return docs
