"""Joins, windows and set operators with the semantics of the survey (FLT, JON, WIN, SET, SRT, AGG)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` in their order, nulls for missing ones (PRJ-03)."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])


def union_all(*frames: DataFrame) -> DataFrame:
    """By name, nulls for missing columns (SET-01)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key by ``order`` (WIN-03, SET-02)."""
    return first_n(df, keys, 1, *order)


def first_n(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of each key (WIN-02)."""
    # Spark prunes each task's groups to n rows before the shuffle (WindowGroupLimit)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def first_link(issues: DataFrame, links: DataFrame, agents: DataFrame) -> DataFrame:
    """Issues with the agent of their first linked request (JON-04); float ids become whole numbers."""
    whole = links.where(F.col("issue_id").isNotNull() & F.col("pr_id").isNotNull()).select(F.col("issue_id").cast("long").alias("issue_id"), F.col("pr_id").cast("long").alias("pr_id"), "link_order")
    named = whole.join(agents.select("pr_id", "agent"), "pr_id")
    return issues.join(keep_first(named, ["issue_id"], "link_order", "pr_id").select("issue_id", "agent"), "issue_id")


def unmatched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either side without a partner, with the side (JON-06, JON-07, SET-07); none means aligned."""
    left = a.select(*keys).exceptAll(b.select(*keys)).withColumn("side", F.lit("left"))
    return left.unionByName(b.select(*keys).exceptAll(a.select(*keys)).withColumn("side", F.lit("right")))


def same_or_unknown(found: Column, expected: Column) -> Column:
    """Equality; null where ``expected`` is unknown (JON-09)."""
    return F.when(expected.isNotNull(), found.eqNullSafe(expected))


def prefix_sums(counts: DataFrame, keys: list[str], order: str, sums: list[str], descending: bool = False, parts: int = 32) -> DataFrame:
    """Append ``<sum>_before``: totals of ``sums`` in the rows of the same key that stand earlier.

    ``counts`` has one row per key and value of ``order``. A key's rows are dealt
    out by value ranges (quantile edges), summed by range, and only then ordered
    inside a range: one key may hold any number of values without one task having
    to sort them all (WIN-04). There are ``keys`` x ``parts`` ranges at most.
    """
    at = [i / parts for i in range(1, parts)]
    edges = counts.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(order, F.array(*map(F.lit, at)), 1000)).alias("_edges"))
    placed = counts.join(F.broadcast(edges), keys)  # one row per key
    placed = placed.withColumn("_part", F.size(F.filter("_edges", lambda e: e < F.col(order)))).drop("_edges")
    totals = placed.groupBy(*keys, "_part").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    by_part = Window.partitionBy(*keys).orderBy(F.col("_part").desc() if descending else F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_t_{s}").over(by_part), F.lit(0)).alias(f"_o_{s}") for s in sums])
    inside = Window.partitionBy(*keys, "_part").orderBy(F.col(order).desc() if descending else F.col(order)).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(offsets), [*keys, "_part"])
    return joined.select(*counts.columns, *[(F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"{s}_before") for s in sums])


def average_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, rank): the mean rank of tied values (WIN-01)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return prefix_sums(counts, keys, value, ["n"]).select(*keys, value, "n", (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("rank"))


def shares(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and shares of the total (AGG-03); null keys are left out."""
    counts = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))
    return counts.crossJoin(total).select(*keys, "n", (F.col("n") / F.col("total")).alias("share"))  # the total is one row


def quotas(df: DataFrame, key: str, target: int) -> DataFrame:
    """Rows wanted of each key out of ``target``, rounded half to even (WIN-07)."""
    return shares(df, [key]).select(key, "n", F.bround(F.col("share") * target).cast("int").alias("quota"))


def ordered_by(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """In the order of a label table (SRT-07)."""
    return df.join(F.broadcast(labels), key, "left").orderBy("position")


def with_rest(df: DataFrame, order: list[Column], most: int) -> tuple[DataFrame, int]:
    """The first rows, and how many more there are (SRT-06)."""
    return df.orderBy(*order).limit(most), max(0, df.count() - most)


def describe_lengths(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """n, empty share in percent, and whole-number median, mean, p90, p99 of text lengths (AGG-07..09)."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(*keys, n.alias("n"))
    q = [F.percentile("n", F.lit(p)).cast("int").alias(name) for p, name in ((0.5, "median"), (0.9, "p90"), (0.99, "p99"))]
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.round(100 * F.avg((F.col("n") == 0).cast("double")), 1).alias("empty_pct"), q[0], F.avg("n").cast("int").alias("mean"), q[1], q[2])


def coverage(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, scored rows and missing percent (AGG-18)."""
    missing = F.round(100 * (F.count("*") - F.count("score")) / F.count("*"), 2)
    return scores.groupBy(*keys).agg(F.count("*").alias("n"), F.count("score").alias("scored"), missing.alias("missing_pct"))


def partially_scored(covered: DataFrame) -> DataFrame:
    """STA-17."""
    return covered.where((F.col("missing_pct") > 0) & (F.col("missing_pct") < 100))
