"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame; all but the last return the columns of ``docs``
(any further columns pass through). Null texts fail the quality rules and go in
the first stage; where a later stage meets one, it stays as it is. Empty tables
give empty results, repeated rows are treated alike.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from calibrant.llm import decontaminate, line_dedup, quality_rules, sentencepiece_codec, simhash
from calibrant.llm._state import drop_folder, new_folder


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trained classifier keep; the texts stay as they are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep_good(docs, quality_rules.train(docs, labels))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on ten sources or more stay in the document with the lowest id only; n_chars follows the text."""
    return _recount(line_dedup.remove(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity from 0.8 on) the document with the lowest id."""
    return simhash.unique(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are little else go. n_chars follows the text."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _recount(decontaminate.clean(docs, items))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of ids and decoded text of every document."""
    return sentencepiece_codec.digests(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def _recount(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text's length in code points, where the table has that column."""
    from pyspark.sql import functions as F

    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", filter_quality),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("sentencepiece", tokenize),
]

#: Training and similarity have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, each written as Parquet into the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            drop_folder(spark, f"{folder}/{k - 1}")  # nothing reads it any more
    return docs
