"""Writers and upserts (SNK-01..13)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overwrite(df: DataFrame, path: str) -> None:
    """SNK-01."""
    df.write.mode("overwrite").parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """One folder per detector; writing one leaves the others alone (SNK-02)."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("detector").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """SNK-06, SNK-07, SNK-08."""
    df.write.mode("append").parquet(path)


def manifest(df: DataFrame, extra: dict | None = None) -> str:
    """A small table (a manifest's counts) as one JSON text (SNK-03)."""
    return json.dumps((extra or {}) | {"rows": [json.loads(x) for x in df.toJSON().collect()]}, indent=1, sort_keys=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, the highest version of each key; of equal ones the new row (SNK-04)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def rebuilt_manifest(scores: DataFrame, prior: DataFrame) -> DataFrame:
    """Versions, rows and scored rows per detector from the data; seconds from the prior manifest (SNK-05)."""
    own = scores.groupBy("detector").agg(F.array_sort(F.collect_set("version")).alias("versions"), F.count("*").alias("n_rows"), F.count("score").alias("scored"))
    return own.join(prior.select("detector", "seconds"), "detector", "left")


def todo(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left to do (SNK-07, JON-11)."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def n_triples(triples: DataFrame) -> DataFrame:
    """One N-Triples line per triple (SNK-09)."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    typed = F.concat(quoted, F.lit("^^<http://www.w3.org/2001/XMLSchema#"), "o_type", F.lit(">"))
    value = F.when(F.col("o_type") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).when(F.col("o_type") == "string", quoted).otherwise(typed)
    return triples.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), value, F.lit(" .")).alias("value"))


def cache_key(model: str, prompt: str, text: Column) -> Column:
    """SHA-256 over model, prompt and text, joined by NUL (SNK-13, HSH-01)."""
    return F.sha2(F.concat_ws("\x00", F.lit(model), F.lit(prompt), text), 256)


def cache_misses(texts: DataFrame, cache: DataFrame, model: str, prompt: str, column: str = "text") -> DataFrame:
    """Texts whose key the cache lacks, with the key and its shard."""
    keyed = texts.withColumn("key", cache_key(model, prompt, F.col(column)))
    return keyed.join(cache.select("key").distinct(), "key", "left_anti").withColumn("shard", F.substring("key", 1, 2))
