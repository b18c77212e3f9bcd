"""Cross-site boilerplate lines, found by how many sites each line is on.

Every line is known by a 128-bit hash. A small HyperLogLog sketch of the sites
merges per hash, partly before the shuffle; lines clearly below the threshold
are dropped and clearly above kept as boilerplate, and only those within the
sketch's error of it are counted exactly. A boilerplate line stays in the
document with the lowest id and is removed from all others. No document text is
shuffled to find lines, and documents meet only the hashes of their own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.llm._state import keep

#: Distinct sites that make a line boilerplate.
MIN_SITES = 10
#: Relative standard error of the sketches, and how many of them lie between "near" and "clear".
ERROR, SPREAD = 0.1, 5.0
#: Lines up to which a table of line hashes is broadcast (some 40 MB); a larger one is joined by shuffling.
BROADCAST_LINES = 500_000


def _hash(line: Column) -> Column:
    """128 bits: two hashes with different seeds."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _lines(df: DataFrame, doc: str, text: str, site: str) -> DataFrame:
    """(doc, site, a, b) for each distinct non-blank line of each row."""
    value = F.col(f"`{text}`").cast("string")
    own = F.filter(F.array_distinct(F.split(value, "\n")), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = df.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{site}`").cast("string").alias("site"), F.explode(own).alias("line"))
    return rows.select("doc", "site", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))


def _sized(lines: DataFrame) -> DataFrame:
    """A checkpointed table of line hashes, broadcast if its counted size allows."""
    return F.broadcast(lines) if lines.count() <= BROADCAST_LINES else lines


def boilerplate(df: DataFrame, doc: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(a, b, keeper): hashes of the lines on ``min_sites`` sites or more, and the lowest id that has each.

    Null sites count for none; a null id is lowest only where no other has the line.
    """
    rows = _lines(df, doc, text, site)
    band = SPREAD * ERROR
    sketched = rows.groupBy("a", "b").agg(F.approx_count_distinct("site", ERROR).alias("sites"), F.min("doc").alias("keeper"))
    candidates = keep(sketched.where(F.col("sites") >= min_sites * (1 - band)))
    clear = F.col("sites") > min_sites * (1 + band)
    near = _sized(candidates.where(~clear).select("a", "b", "keeper"))
    # a task hands on each site of a line once, before and after the shuffle
    each = rows.where(F.col("site").isNotNull()).join(near, ["a", "b"]).select("a", "b", "keeper", "site").distinct()
    exact = each.groupBy("a", "b", "keeper").agg(F.count("*").alias("sites"))
    return candidates.where(clear).select("a", "b", "keeper").unionByName(exact.where(F.col("sites") >= min_sites).select("a", "b", "keeper"))


def _among(values: Column, x: Column) -> Column:
    """Whether a sorted array holds ``x``; long arrays are halved until the place is found."""
    n = F.size(values)

    def half(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        up = F.coalesce(F.get(values, middle) < x, F.lit(False))
        return F.struct(F.when(up, middle + 1).otherwise(s["low"]).alias("low"), F.when(up, s["high"]).otherwise(middle).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    place = F.aggregate(steps, F.struct(F.lit(0).alias("low"), n.alias("high")), half, lambda s: s["low"])
    return F.when(n <= 16, F.array_contains(values, x)).otherwise(F.coalesce(F.get(values, place) == x, F.lit(False)))


def remove(df: DataFrame, doc: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``df`` with boilerplate lines taken out of ``text``, except in the document that keeps each.

    Columns and rows stay, whatever the columns' names; null and empty texts stay
    as they are, and so do blank lines; very long texts take a time in proportion to
    their lines; of rows with the keeper's id all keep the line. A text whose lines
    all go becomes empty.
    """
    found = keep(boilerplate(df, doc, text, site, min_sites))
    # the lowest id keeps the line; a null keeper (all ids null) is kept by all of them
    rows = _lines(df, doc, text, site)
    lost = rows.join(_sized(found), ["a", "b"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    lost = lost.select("doc", F.struct("a", "b").alias("h")).distinct().groupBy(F.col("doc").alias("of")).agg(F.array_sort(F.collect_list("h")).alias("lost"))
    own = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)], F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    joined = own.join(lost, own["doc"].eqNullSafe(lost["of"]), "left")
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), _hash(x).alias("h")))
    kept = F.array_join(F.transform(F.filter(lines, lambda x: ~_among(F.col("lost"), x["h"])), lambda x: x["line"]), "\n")
    cleaned = F.when(F.col("lost").isNull(), F.col("text")).otherwise(kept)
    return joined.select(*[(cleaned if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(df.columns)])
