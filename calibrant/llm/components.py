"""Connected components of a graph of 64-bit nodes, as joins that converge in logarithmic rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.llm._state import Rounds, keep

#: Links of a node from which on they are not gathered by node, and nodes with so many that are broadcast at most.
HUB, BROADCAST_HUBS = 1000, 200_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge; root is the lowest node that it reaches.

    Alternates large-star and small-star steps. Links to one neighbour meet in
    aggregates (minimum by node); what is joined back to a hub's links is broadcast,
    so that no task gathers them. Each round is written to the shared folder and
    replaces the one before; the rounds end when no link changes any more. Repeated
    links and links of a node with itself change nothing; no links give no rows.
    """
    rounds = Rounds(edges.sparkSession, "components")
    links = rounds.put(_ordered(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    before = _signature(links)
    while True:
        # large star: every larger neighbour of u is linked to the lowest of u and its neighbours
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _ordered(_joined(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # small star: u and its lower neighbours are linked to the lowest of these
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _joined(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = rounds.put(_ordered(small))
        rounds.drop_before()
        now = _signature(links)
        if now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _joined(links: DataFrame, of: DataFrame) -> DataFrame:
    """``links`` with the m of their u in ``of`` (u, m, n links); the links of hubs stay where they are."""
    of = keep(of)
    hubs = of.where(F.col("n") > HUB).select("u", "m")
    n = hubs.count()
    if not 0 < n <= BROADCAST_HUBS:
        return links.join(of.select("u", "m"), "u")
    hubs = F.broadcast(hubs)
    others = links.join(hubs.select("u"), "u", "left_anti").join(of.where(F.col("n") <= HUB).select("u", "m"), "u")
    return links.join(hubs, "u").unionByName(others)


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links from the larger to the lower node."""
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _signature(links: DataFrame) -> tuple:
    """Equal for equal sets of links; 2**-128 by chance for others."""
    mixed = [F.bit_xor(F.xxhash64(F.lit(s), "u", "v")).alias(f"x{s}") for s in (1, 2)]
    return tuple(links.agg(F.count("*").alias("n"), *mixed).first())
