"""A bounded, repeatable sample of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.llm._state import keep

#: Documents of each class at most, and bytes of their texts in all.
SAMPLE_DOCS, SAMPLE_BYTES = 1000, 8_000_000


def sample(docs: DataFrame, labels: DataFrame, label: str, doc: str = "doc_id", text: str = "text", where: Column | None = None, per_class: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """Whole texts (column text) with their 0/1 label (column label), and the labels' counts.

    The documents of each class with the lowest hashes of their ids are taken, as
    far as all texts together stay within ``most_bytes``; the rest of the table is
    not gathered. ``where`` narrows the labelled rows beforehand. Rows with a null
    id, label or text teach nothing, nor do ids with both labels; a repeated id
    counts once, with the lowest of its texts.
    """
    rows = labels.select(F.col(doc).alias("doc"), F.col(label).cast("int").alias("label")).where(F.col("doc").isNotNull() & F.col("label").isin(0, 1))
    if where is not None:
        rows = rows.where(where)
    one = F.min("label") == F.max("label")
    rows = rows.groupBy("doc").agg(F.min("label").alias("label"), one.alias("one")).where("one").select("doc", "label")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    order = F.xxhash64(F.col("doc").cast("string"))
    picked = [rows.where(F.col("label") == c).orderBy(order, "doc").limit(per_class) for c in (0, 1)]
    ids = [(r["doc"], r["label"]) for part in picked for r in part.collect()]
    spark = docs.sparkSession
    own = docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    chosen = F.broadcast(spark.createDataFrame(ids, rows.schema))  # 2 * per_class rows at most
    # the one pass over the texts; repeats are settled before the shuffle
    joined = keep(own.join(chosen, "doc").groupBy("doc", "label").agg(F.min("text").alias("text")))
    # the sizes of a bounded number of texts decide how many of them fit
    sizes = sorted((r["order"], r["n"], r["doc"]) for r in joined.select(order.alias("order"), F.octet_length("text").alias("n"), "doc").collect())
    fit, total = [], 0
    for _, n, name in sizes:
        if total + n <= most_bytes:
            fit.append((name,))
            total += n
    kept = F.broadcast(spark.createDataFrame(fit, rows.select("doc").schema).distinct())
    return joined.join(kept, "doc", "left_semi").select("label", "text"), counts
