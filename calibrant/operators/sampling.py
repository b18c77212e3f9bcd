"""Repeatable sampling, allocation and length matching (SMP-01..09).

Draws order rows by ``md5(seed | row id)``: the same rows on any cluster, and in
any other engine. Null keys are left out, as the grouping of the source does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrant.functions.stats import replicated, resampled
from calibrant.functions.structure import hash_order
from calibrant.operators.relational import first_n, quotas


def _known(df: DataFrame, keys: list[str]) -> DataFrame:
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def allocate(df: DataFrame, target: int, keys: list[str] | None = None, row: str = "row_id", seed: int = 7) -> DataFrame:
    """At most ``target`` rows of each agent and genre (SMP-01, SMP-02)."""
    keys = keys or ["agent", "genre"]
    return first_n(_known(df, keys), keys, target, hash_order(seed, F.col(row)), row)


def allocation_report(df: DataFrame, target: int, floor: int, keys: list[str] | None = None) -> DataFrame:
    """available, sampled and below_floor of each cell (SMP-01)."""
    keys = keys or ["agent", "genre"]
    n = F.count("*")
    return _known(df, keys).groupBy(*keys).agg(n.alias("available"), F.least(n, F.lit(target)).cast("long").alias("sampled"), (n < floor).alias("below_floor"))


def draw(df: DataFrame, n: int, row: str, seed: int = 7) -> DataFrame:
    """``n`` rows (SMP-05, SMP-07)."""
    return df.orderBy(hash_order(seed, F.col(row)), row).limit(n)


def draw_artifacts(df: DataFrame, n: int, keys: list[str], seed: int = 7) -> DataFrame:
    """All rows of ``n`` drawn keys (SMP-06)."""
    chosen = df.select(*keys).distinct().orderBy(hash_order(seed, *[F.col(k) for k in keys]), *keys).limit(n)
    return df.join(chosen, keys, "left_semi")


def _strata(df: DataFrame) -> DataFrame:
    """Diffs match within their extension, a missing one is "none" for positives; other genres as a whole."""
    return df.withColumn("stratum", F.when(F.col("genre") == "diff", F.coalesce("ext", F.lit("none"))).otherwise(F.lit("")))


def length_bins(positives: DataFrame, negatives: DataFrame, bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``bin``: intervals (low, high] between the positives' quantiles, outer ones open, equal edges merged."""
    pos = _strata(positives)
    neg = negatives.withColumn("stratum", F.when(F.col("genre") == "diff", F.col("ext")).otherwise(F.lit(""))).where(F.col("stratum").isNotNull())
    inner = F.percentile("n_chars", F.array(*[F.lit(i / bins) for i in range(1, bins)]))
    edges = pos.groupBy("genre", "stratum").agg(F.array_distinct(inner).alias("edges"))
    edges = F.broadcast(edges)  # a row per genre or extension

    def binned(df: DataFrame) -> DataFrame:
        inside = df.join(edges, ["genre", "stratum"])
        return inside.withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("n_chars"))) + 1).drop("edges")

    return binned(pos), binned(neg)


def lowest(df: DataFrame, keys: list[str], wanted: DataFrame, n: str, row: str, seed: int = 7) -> DataFrame:
    """The rows of each key with the lowest hashes, as many as its ``n`` in ``wanted`` (a row per key).

    Rows are counted by the first 16 bits of their hash, which tells the bits up to
    which all rows are taken; only rows at that edge are ordered. No task orders a
    whole key, however many rows it has.
    """
    own = df.withColumn("_lowest_h", hash_order(seed, F.col(row)))
    own = own.withColumn("_lowest_b", F.conv(F.substring("_lowest_h", 1, 4), 16, 10).cast("int"))
    rows = own.groupBy(*keys, "_lowest_b").agg(F.count("*").alias("_lowest_c"))
    up_to = F.sum("_lowest_c").over(Window.partitionBy(*keys).orderBy("_lowest_b").rowsBetween(Window.unboundedPreceding, 0))  # 65,536 rows a key at most
    # a key's whole steps; the next one is the edge, where what is still wanted is taken
    steps = rows.select(*keys, "_lowest_b", up_to.alias("_lowest_t")).join(F.broadcast(wanted.select(*keys, F.col(n).alias("_lowest_w"))), keys)
    whole = F.col("_lowest_t") <= F.col("_lowest_w")
    edges = steps.groupBy(*keys).agg(F.coalesce(F.min(F.when(~whole, F.col("_lowest_b"))), F.lit(1 << 16)).alias("_lowest_edge"), (F.first("_lowest_w") - F.coalesce(F.max(F.when(whole, F.col("_lowest_t"))), F.lit(0))).alias("_lowest_left"))
    placed = own.join(F.broadcast(edges), keys)  # a row per key
    at = placed.where(F.col("_lowest_b") == F.col("_lowest_edge")).withColumn("_lowest_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_lowest_h", row)))
    return placed.where(F.col("_lowest_b") < F.col("_lowest_edge")).select(*df.columns).unionByName(at.where(F.col("_lowest_n") <= F.col("_lowest_left")).select(*df.columns))


def match_lengths(positives: DataFrame, negatives: DataFrame, bins: int = 10, row: str = "row_id", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(matched negatives, report) (SMP-03).

    Negatives are drawn to the positives' histogram; a short bin is reported with
    wanted and got, not filled from others.
    """
    pos, neg = length_bins(positives, negatives, bins)
    cell = ["genre", "stratum", "bin"]
    wanted = pos.groupBy(*cell).agg(F.count("*").alias("wanted"))
    matched = lowest(neg, cell, wanted, "wanted", row, seed)
    pool = neg.groupBy(*cell).agg(F.count("*").alias("pool"))
    got = F.least(F.col("wanted"), F.coalesce("pool", F.lit(0)))
    report = wanted.join(pool, cell, "left").select(*cell, "wanted", got.alias("got")).where("got < wanted")
    return matched, report


def quota_draw(pool: DataFrame, wanted: DataFrame, target: int, row: str, key: str = "language", seed: int = 7) -> DataFrame:
    """``target`` rows, by the shares of ``key`` in ``wanted``, topped up from the rest (SMP-04)."""
    picked = lowest(pool.where(F.col(key).isNotNull()), [key], quotas(wanted, key, target), "quota", row, seed)
    rest = pool.join(picked.select(row), row, "left_anti")
    both = picked.withColumn("_first", F.lit(0)).unionByName(rest.withColumn("_first", F.lit(1)))
    return both.orderBy("_first", hash_order(seed, F.col(row)), row).limit(target).drop("_first")


def grouped_folds(df: DataFrame, label: str, group: str, row: str, folds: int = 5, seed: int = 7) -> DataFrame:
    """Append ``fold``: whole groups to one fold; rows without a group are groups of their own (SMP-09).

    Groups of like size (by powers of two) and like share of ones (by tenths) are a
    stratum, whose groups are dealt out to the folds in turn, in the order of their
    hashes: folds have equally many groups of a stratum, to one. Groups are counted
    by the first 16 bits of the hash, so no task orders a whole stratum.
    """
    name = F.when(F.coalesce(F.col(group).cast("string"), F.lit("")) == "", F.concat(F.lit("row:"), F.col(row))).otherwise(F.concat(F.lit("repo:"), F.col(group)))
    marked = df.withColumn("_group", name)
    ones = F.coalesce(F.sum(F.col(label).cast("int")), F.lit(0))
    sizes = marked.groupBy("_group").agg(F.count("*").alias("_size"), ones.alias("_ones"))
    stratum = [F.length(F.bin("_size")).alias("_large"), F.expr("10 * _ones div _size").alias("_share")]
    own = sizes.select("_group", *stratum, hash_order(seed, F.col("_group")).alias("_h"))
    own = own.withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    step = ["_large", "_share", "_b"]
    before = F.sum("_c").over(Window.partitionBy("_large", "_share").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))  # 65,536 rows a stratum at most
    earlier = own.groupBy(*step).agg(F.count("*").alias("_c")).select(*step, F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*step).orderBy("_h", "_group"))
    fold = F.pmod(place + F.col("_large") + F.col("_share"), F.lit(folds)).cast("int")
    dealt = own.join(earlier, step).select("_group", fold.alias("fold"))
    return marked.join(dealt, "_group").drop("_group")


def bootstrap_counts(counts: DataFrame, keys: list[str], sums: list[str], replicates: int, seed: int = 7) -> DataFrame:
    """(keys, replicate, sums): the rows of each key counted as often as a resample with replacement draws them (SMP-08).

    ``counts`` has a row per key, with how many rows stand for it in ``sums``; draws
    are hashes, so every engine draws the same, and no row is numbered or shuffled.
    """
    names = [F.lit(str(seed)), *[F.col(k) for k in keys]]
    return replicated(counts.select(*keys, *sums), replicates).select(*keys, "replicate", *[resampled(F.col(c), *names, F.lit(c), F.col("replicate")).alias(c) for c in sums])
