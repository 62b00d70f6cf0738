"""Documents to training tokens: language ID, line dedup, near-dedup, decontamination, byte-level BPE.

Each stage works on all its predecessor kept and reads the columns of ``documents``. Rows with null or repeated ids,
null or empty texts pass by the rules stated in each stage. Stages after the first keep clean documents whole.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetweave.llm import byte_bpe, decontamination, language_id, line_dedup, similar_texts
from fleetweave.llm.scratch import stored

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; those without a letter, null texts too, are rejected."""
    return language_id.accepted(docs, language_id.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go, except where they stand first; ``n_chars`` follows the text.

    A document that is boilerplate throughout stays, empty.
    """
    cleaned = line_dedup.without_boilerplate(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group linked by similarity 0.8 of five-word shingles; repeated rows are a group.

    Candidates are the groups of the SimHash index and, for what 64 bits can't reach, positional minima.
    """
    return similar_texts.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows of one id, null ids too, are judged each by its own text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaked = decontamination.contaminated(docs, benchmark)
    leaked = leaked.select(F.col("id").alias("_leaked_id"), F.col("digest").alias("_leaked_digest")).distinct()
    own = F.col("doc_id").eqNullSafe(F.col("_leaked_id")) & (F.xxhash64("text") == F.col("_leaked_digest"))
    return docs.join(leaked, own, "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, text): the ids of every whole text, and the text that they decode to."""
    vocabulary = public_tokenizers.path(VOCABULARY)
    decoded = byte_bpe.decode(byte_bpe.encode(docs, vocabulary, public_tokenizers.PATTERN), vocabulary)
    return decoded.select(F.col("id").alias("doc_id"), F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
                          F.col("data").cast("string").alias("text"))


STAGES = [("language id", language), ("line dedup", lines), ("simhash near-dedup", near_dedup),
          ("decontamination", decontaminate), ("byte-level bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
