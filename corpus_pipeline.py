"""A corpus pipeline of the operators in ``tidemark.llm``: languages, near copies, repeated passages, mixture, tokens.

Each stage takes ``(spark, docs, sf_dir)`` with the columns of documents and returns them, the last one its digests. ``run`` writes
each stage's rows to the shared folder and reads them again, so a stage never repeats the work of the one before.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard, langid, mixing, substring
from tidemark.llm.queries import workers_find_package
from tidemark.session import scratch_path

#: A text is rejected if its language is unknown or its best mean probability is below this.
MIN_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known well enough; a document without a letter has none."""
    workers_find_package(spark)
    model = langid.fit(docs)
    seen = docs.withColumn("__lang", langid.language(F.col("text"), model))
    seen = seen.where((F.col("__lang.lang_pred") != langid.UNKNOWN) & (F.col("__lang.score") >= MIN_SCORE))
    return seen.select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five words, similarity 0.8); rows without an id stay."""
    workers_find_package(spark)
    found = jaccard.jaccard_components(docs, 80, 100, 5)
    others = found.where("node <> component").select(F.col("node").alias("__node"))
    return docs.join(others, F.col("doc_id") == F.col("__node"), "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that start earlier; texts that lose nothing stay as they are."""
    workers_find_package(spark)
    d = substring.substring_dedup(docs, out="__dedup")
    text = F.when(F.col("__dedup.n_removed") > 0, F.col("__dedup.kept")).otherwise(F.col("text"))
    d = d.withColumn("text", text)
    return d.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents as often as their source's target asks; null and empty texts hold no words and are not taken."""
    workers_find_package(spark)
    d = mixing.repeated(docs)
    return d.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and the decoded documents, a row per document of the mixture; a null text is encoded as an empty one."""
    workers_find_package(spark)
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(bpe.encode(docs, vocabulary), vocabulary)


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("substring_dedup", substring_dedup),
          ("source_mixing", source_mixing), ("byte_bpe", byte_bpe)]

#: Models, tokens and similarity joins have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, applied to the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
