"""Metric tables per detector and genre (STA-05..10, STA-15..18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.functions import stats as S
from calibrant.operators.relational import average_rank, ordered_by  # noqa: F401

CELL = ["detector", "genre"]


def _count(which: Column) -> Column:
    """Rows of a set, scored or not."""
    return F.sum(F.when(which, 1).otherwise(0))


def metrics(df: DataFrame, replicates: int = 500, seed: int = 7) -> DataFrame:
    """The 16-column table: sizes, AUROC against both negatives with its intervals, operating point, rates (STA-05)."""
    pos, n1 = S.is_positive(), S.is_matched()
    n2, n3 = F.col("set") == "N2", F.col("set") == "N3"
    known = df.where(F.col("genre").isNotNull())
    counts = S.score_counts(known, CELL, pos, n1, n1_all=F.col("set") == "N1", n2=n2, n3=n3)
    sizes = known.groupBy(*CELL).agg(_count(pos).alias("n_pos"), _count(n1).alias("n_neg")).where("n_pos > 0 AND n_neg > 0")
    point = S.operating_point(counts, CELL)
    a1 = S.auroc_interval(counts, CELL, "p", "n", "auroc_n1", "ci_lo", "ci_hi", replicates, seed)
    a2 = S.auroc_interval(counts, CELL, "p", "n2", "auroc_n2", "ci_n2_lo", "ci_n2_hi", replicates, seed)
    # rates at the threshold come from the counts, not from the rows again
    at = counts.join(F.broadcast(point), CELL, "left")
    above = F.col("score") >= F.col("threshold")

    def rate(column: str) -> Column:
        return F.try_divide(F.sum(F.when(above, F.col(column)).otherwise(0)), F.sum(column))

    rates = at.groupBy(*CELL).agg(F.count(F.when(F.col("p") > 0, 1)).alias("distinct_scores"), F.when(F.max("threshold").isNotNull(), rate("n1_all")).alias("fpr_n1_unmatched"), F.when(F.max("threshold").isNotNull(), rate("n3")).alias("fpr_n3_bots"))
    out = sizes.join(rates, CELL, "left").join(a1, CELL, "left").join(a2, CELL, "left").join(point, CELL, "left")
    return out.select(*CELL, "n_pos", "n_neg", "distinct_scores", "auroc_n1", "ci_lo", "ci_hi", "auroc_n2", "ci_n2_lo", "ci_n2_hi", "threshold", F.col("fpr").alias("fpr_achieved"), F.col("recall").alias("recall_at_fpr"), "fpr_n1_unmatched", "fpr_n3_bots")


def bootstrap_interval(df: DataFrame, replicates: int = 500, seed: int = 7) -> DataFrame:
    """(detector, genre, auroc, ci_lo, ci_hi) against matched negatives (STA-02)."""
    counts = S.score_counts(df, CELL, S.is_positive(), S.is_matched())
    return S.auroc_interval(counts, CELL, replicates=replicates, seed=seed)


def by_length(df: DataFrame, bins: int = 5, cell_floor: int = 200, bin_floor: int = 50, replicates: int = 500, seed: int = 7) -> DataFrame:
    """AUROC by quintile of the pooled lengths, (low, high], outer ones open (STA-06)."""
    used = df.where((S.is_positive() | S.is_matched()) & F.col("genre").isNotNull())
    cells = used.groupBy(*CELL).agg(_count(S.is_positive()).alias("np"), _count(S.is_matched()).alias("nn"), F.percentile("n_chars", F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("edges"))
    cells = F.broadcast(cells.where((F.col("np") >= cell_floor) & (F.col("nn") >= cell_floor)).select(*CELL, "edges"))
    binned = used.join(cells, CELL).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("n_chars"))) + 1)
    keys = [*CELL, "bin"]
    sizes = binned.groupBy(*keys).agg(F.first("edges").alias("edges"), _count(S.is_positive()).alias("n_pos"), _count(S.is_matched()).alias("n_neg")).where((F.col("n_pos") >= bin_floor) & (F.col("n_neg") >= bin_floor))
    a = S.auroc_interval(S.score_counts(binned, keys, S.is_positive(), S.is_matched()), keys, replicates=replicates, seed=seed)
    low = F.when(F.col("bin") == 1, 0).otherwise(F.round(F.try_element_at("edges", F.col("bin") - 1), 6).cast("int"))
    high = F.when(F.col("bin") == bins, -1).otherwise(F.round(F.try_element_at("edges", F.col("bin")), 6).cast("int"))
    return sizes.join(a, keys, "left").select(*keys, low.alias("chars_from"), high.alias("chars_to"), "n_pos", "auroc", "ci_lo", "ci_hi")


def by_agent(df: DataFrame, floor: int = 100, negatives: int = 200, replicates: int = 500, seed: int = 7) -> DataFrame:
    """AUROC of each agent against the genre's matched negatives (STA-07)."""
    counts = S.score_counts(df, [*CELL, "agent"], S.is_positive() & F.col("agent").isNotNull(), S.is_matched())
    # the negatives are shared: their counts per score meet every agent's
    shared = counts.groupBy(*CELL, "score").agg(F.sum("n").alias("n"))
    agents = counts.where("p > 0").select(*CELL, "agent", "score", "p")
    names = agents.select(*CELL, "agent").distinct()
    spread = shared.join(F.broadcast(names), CELL)  # a handful of agents
    both = spread.select(*CELL, "agent", "score", F.lit(0).cast("long").alias("p"), "n").unionByName(agents.withColumn("n", F.lit(0).cast("long")))
    merged = both.groupBy(*CELL, "agent", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    sizes = df.where(S.is_positive() & F.col("agent").isNotNull()).groupBy(*CELL, "agent").agg(F.count("*").alias("n_pos")).where(F.col("n_pos") >= floor)
    enough = df.where(S.is_matched()).groupBy(*CELL).agg(F.count("*").alias("k")).where(F.col("k") >= negatives).drop("k")
    return sizes.join(enough, CELL, "left_semi").join(S.auroc_interval(merged, [*CELL, "agent"], replicates=replicates, seed=seed), [*CELL, "agent"], "left")


def by_language(df: DataFrame, floor: int = 100, genre: str | None = "diff", replicates: int = 500, seed: int = 7) -> DataFrame:
    """AUROC per file extension, of diffs (STA-08)."""
    used = df.where(F.col("ext").isNotNull())
    used = used.where(F.col("genre") == genre) if genre else used
    keys = ["detector", "ext"]
    sizes = used.groupBy(*keys).agg(_count(S.is_positive()).alias("n_pos"), _count(S.is_matched()).alias("n_neg")).where((F.col("n_pos") >= floor) & (F.col("n_neg") >= floor))
    return sizes.join(S.auroc_interval(S.score_counts(used, keys, S.is_positive(), S.is_matched()), keys, replicates=replicates, seed=seed), keys, "left")


def automation_gap(df: DataFrame, floor: int = 100, target: float = 0.05) -> DataFrame:
    """False positives on people and on automation at one threshold (STA-09)."""
    n3 = F.col("set") == "N3"
    counts = S.score_counts(df, CELL, S.is_positive(), S.is_matched(), b=n3)
    sizes = df.groupBy(*CELL).agg(_count(S.is_positive()).alias("np"), _count(S.is_matched()).alias("nn"), _count(n3).alias("n_bots"))
    sizes = sizes.where((F.col("np") >= floor) & (F.col("nn") >= floor) & (F.col("n_bots") >= floor))
    point = S.operating_point(counts, CELL, target)
    rates = counts.join(F.broadcast(point), CELL).groupBy(*CELL, "fpr", "recall").agg(F.try_divide(F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("b")).otherwise(0)), F.sum("b")).alias("fpr_bots"))
    joined = sizes.join(rates, CELL, "left")
    ratio = F.try_divide(F.col("fpr_bots"), F.nullif(F.col("fpr"), F.lit(0.0)))
    return joined.select(*CELL, "n_bots", F.col("fpr").alias("fpr_human"), "fpr_bots", ratio.alias("ratio"), F.col("recall").alias("recall_agents"))


def published_points(df: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Rates and Youden's J at published thresholds (STA-10)."""
    at = df.sparkSession.createDataFrame(list(thresholds.items()), "detector string, threshold double")
    joined = df.join(F.broadcast(at), "detector")
    s, t = F.col("score"), F.col("threshold")
    rows = joined.groupBy(*CELL, "threshold").agg(S.published_rate(S.is_matched(), s, t).alias("fpr_prellm"), S.published_rate(S.is_positive(), s, t).alias("recall_agents"), S.published_rate(F.col("set") == "N3", s, t).alias("fpr_bots"))
    return rows.where("fpr_prellm IS NOT NULL AND recall_agents IS NOT NULL").withColumn("youden_j", F.col("recall_agents") - F.col("fpr_prellm"))


def calibration(df: DataFrame, detectors: list[str], floor: int = 200, bins: int = 10) -> DataFrame:
    """Calibration error per cell of probabilistic detectors (STA-11)."""
    used = df.where(F.col("detector").isin(detectors) & (S.is_positive() | S.is_matched())).withColumn("label", S.is_positive().cast("int"))
    return S.ece(used, CELL, bins=bins).where(F.col("n") >= floor)


def temporal_shift(metric: DataFrame) -> DataFrame:
    """AUROC against contemporary minus against earlier people (STA-15)."""
    return metric.where("auroc_n2 IS NOT NULL").select(*CELL, (F.col("auroc_n2") - F.col("auroc_n1")).alias("shift"))


def worked_example(df: DataFrame, metric: DataFrame, text_key: str, value: Column) -> DataFrame:
    """Score, threshold and flag of each detector for the first row that matches (STA-16, FLT-16)."""
    row = df.where(value).groupBy("detector", "genre").agg(F.min_by("score", text_key).alias("score"))
    return row.join(F.broadcast(metric.select(*CELL, "threshold")), CELL).withColumn("flagged", F.col("score") >= F.col("threshold"))


def figure_means(gap: DataFrame) -> DataFrame:
    """Genre means of both false positive rates (STA-18, SNK-12)."""
    return gap.groupBy("detector").agg(F.avg("fpr_human").alias("human"), F.avg("fpr_bots").alias("bots"), F.min("fpr_bots").alias("least"), F.max("fpr_bots").alias("most"))
