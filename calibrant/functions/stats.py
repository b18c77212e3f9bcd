"""Two-sample statistics as set-based plans (STA-01..18).

Everything starts from counts per cell and distinct score, so a cell with few
distinct scores is a few rows whatever its size, and running totals are taken
by ranges of scores (``prefix_sums``). Missing scores are null and drop out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.functions.structure import clip, edges
from calibrant.operators.relational import prefix_sums

TARGET_FPR = 0.05
#: Ranges of scores whose counts are resampled; with fewer distinct scores each has one of its own, if it holds enough rows.
RANGES = 128
#: Replicates that one row computes.
REPLICATES_A_ROW = 25


def is_positive() -> Column:
    return F.col("set") == "P"


def is_matched() -> Column:
    """Pre-cutoff human and matched; an unknown flag is not (FLT-11)."""
    return (F.col("set") == "N1") & F.col("matched").eqNullSafe(True)


def score_counts(df: DataFrame, keys: list[str], positive: Column, negative: Column, score: str = "score", **more: Column) -> DataFrame:
    """(keys, score, p, n, ...): rows of each side at each score."""
    sides = {"p": positive, "n": negative, **more}
    sums = [F.sum(F.when(c, 1).otherwise(0)).alias(a) for a, c in sides.items()]
    return df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(*sums)


def auroc(counts: DataFrame, keys: list[str], p: str = "p", n: str = "n", name: str = "auroc") -> DataFrame:
    """Chance that a positive outscores a negative, ties half; null if a side is empty (STA-01)."""
    rows = prefix_sums(counts, keys, "score", [n])
    twice = F.sum(F.col(p) * (2 * F.col(f"{n}_before") + F.col(n)))
    return rows.groupBy(*keys).agg(F.try_divide(twice, 2 * F.sum(p) * F.sum(n)).alias(name))


def operating_point(counts: DataFrame, keys: list[str], target: float = TARGET_FPR) -> DataFrame:
    """(keys, threshold, fpr, recall): the lowest score whose inclusive false positive rate is within the target, else the top one (STA-04)."""
    counts = counts.where("p > 0 OR n > 0")  # only the two sides' own scores are thresholds
    totals = counts.groupBy(*keys).agg(F.sum("p").alias("np"), F.sum("n").alias("nn")).where("np > 0 AND nn > 0")
    rows = prefix_sums(counts, keys, "score", ["p", "n"], descending=True).join(F.broadcast(totals), keys)  # totals: a row per cell
    fpr = (F.col("n_before") + F.col("n")) / F.col("nn")
    recall = (F.col("p_before") + F.col("p")) / F.col("np")
    point = F.struct("score", fpr.alias("fpr"), recall.alias("recall"))
    chosen = F.coalesce(F.min(F.when(fpr <= target, point)), F.max(point))
    return rows.groupBy(*keys).agg(chosen.alias("o")).select(*keys, F.col("o.score").alias("threshold"), F.col("o.fpr").alias("fpr"), F.col("o.recall").alias("recall"))


def score_ranges(counts: DataFrame, keys: list[str], p: str = "p", n: str = "n", ranges: int = RANGES) -> DataFrame:
    """(keys, ranges): for each key its rows by ranges of scores, array<struct<r,p,n,start,twice>>.

    A range holds about as many rows of both sides as any other, never part of a
    score. start counts the n below it; twice is double the sum, over its p, of the
    n inside it that are lower (ties half).
    """
    used = counts.where((F.col(p) > 0) | (F.col(n) > 0)).select(*keys, "score", F.col(p).alias("p"), F.col(n).alias("n"), (F.col(p) + F.col(n)).alias("t"))
    totals = used.groupBy(*keys).agg(F.sum("t").alias("all"))
    placed = prefix_sums(used, keys, "score", ["t", "n"]).join(F.broadcast(totals), keys)  # totals: a row per cell
    r = F.floor(F.col("t_before") * ranges / F.col("all")).cast("int")
    low = F.min("n_before")
    cells = placed.groupBy(*keys, r.alias("r")).agg(F.sum("p").alias("p"), F.sum("n").alias("n"), low.alias("start"), (F.sum(F.col("p") * (2 * F.col("n_before") + F.col("n"))) - 2 * F.sum("p") * low).alias("twice"))
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", "p", "n", "start", "twice"))).alias("ranges"))


def resampled(count: Column, *names: Column) -> Column:
    """A Poisson draw with mean ``count``, by a hash of the names: how often a resample takes so many rows.

    The quantile is expanded about the normal one up to the skewness, which gives
    the probabilities of one row's draws to about 0.01, and those of more rows better.
    """
    h = F.md5(F.concat_ws("|", *names))
    u = [(F.conv(F.substring(h, k, 8), 16, 10).cast("double") + 0.5) / 4294967296.0 for k in (1, 9)]
    root = F.sqrt(count.cast("double"))
    z = F.greatest(F.sqrt(-2.0 * F.log(u[0])) * F.cos(6.283185307179586 * u[1]), -3.0 * root)
    return F.greatest(F.floor(count + root * z + F.when(count > 0, (z * z - 1.0) / 6.0).otherwise(0.0) + 0.5), F.lit(0)).cast("double")


def replicated(rows: DataFrame, replicates: int) -> DataFrame:
    """Each row once per ``replicate``, dealt out over all tasks in strides before the last step."""
    strides = -(-replicates // REPLICATES_A_ROW)
    dealt = rows.withColumn("_stride", F.explode(F.sequence(F.lit(0), F.lit(strides - 1)))).repartition("_stride")
    first = F.col("_stride") * REPLICATES_A_ROW + 1
    return dealt.withColumn("replicate", F.explode(F.sequence(first, F.least(first + REPLICATES_A_ROW - 1, F.lit(replicates))))).drop("_stride")


def auroc_interval(counts: DataFrame, keys: list[str], p: str = "p", n: str = "n", name: str = "auroc", low: str = "ci_lo", high: str = "ci_hi", replicates: int = 500, seed: int = 7) -> DataFrame:
    """``auroc`` with the 2.5 and 97.5 percentiles of its resamples (STA-02); all null if a side is empty.

    Both sides are resampled by their counts per range of scores, so the work follows
    cells, ranges and replicates, whatever the number of rows; within a range the
    chance that a positive is higher stays that of the rows.
    """
    ranges = score_ranges(counts, keys, p, n)
    total = lambda f: F.aggregate("ranges", F.lit(0).cast("long"), lambda a, x: a + f(x))
    exact = ranges.select(*keys, F.try_divide(total(lambda x: 2 * x["p"] * x["start"] + x["twice"]), 2 * total(lambda x: x["p"]) * total(lambda x: x["n"])).alias(name))
    named = [F.lit(str(seed)), *[F.col(k) for k in keys]]

    def drawn(x: Column) -> Column:
        at = [F.col("replicate"), x["r"]]
        inside = F.coalesce(F.try_divide(x["twice"].cast("double"), x["p"] * x["n"]), F.lit(0.0))
        return F.struct(resampled(x["p"], *named, F.lit("p"), *at).alias("p"), resampled(x["n"], *named, F.lit("n"), *at).alias("n"), inside.alias("inside"))

    def add(s: Column, x: Column) -> Column:
        return F.struct((s["p"] + x["p"]).alias("p"), (s["n"] + x["n"]).alias("n"), (s["u"] + x["p"] * (2.0 * s["n"] + x["n"] * x["inside"])).alias("u"))

    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("p", "n", "u")])
    value = F.aggregate(F.transform("ranges", drawn), zero, add, lambda s: F.try_divide(s["u"], 2.0 * s["p"] * s["n"]))
    each = replicated(ranges, replicates).select(*keys, value.alias("v"))
    bounds = each.groupBy(*keys).agg(F.percentile("v", F.lit(0.025)).alias(low), F.percentile("v", F.lit(0.975)).alias(high))
    return exact.join(bounds, keys, "left")


def rate_at(which: Column, score: Column, threshold: Column) -> Column:
    """Share of the scored rows of ``which`` at or above the threshold, as an aggregate (STA-03)."""
    return F.avg(F.when(which & score.isNotNull(), (score >= threshold).cast("double")))


def published_rate(which: Column, score: Column, threshold: Column) -> Column:
    """As ``rate_at``, but a missing score counts as not flagged (STA-10)."""
    return F.avg(F.when(which, F.coalesce((score >= threshold).cast("double"), F.lit(0.0))))


def calibration_bin(score: Column, bins: int = 10) -> Column:
    """1-based bin: the first is closed, the others (low, high] (STA-11)."""
    borders = F.array(*[F.lit(e) for e in edges(bins)])
    return F.greatest(F.size(F.filter(borders, lambda e: e < score)), F.lit(1))


def ece(df: DataFrame, keys: list[str], score: str = "score", label: str = "label", bins: int = 10) -> DataFrame:
    """(keys, n, base_rate, ece, signed_gap): calibration error over bins, and its signed form; scores outside [0, 1] fall in no bin."""
    rows = df.where(F.col(score).isNotNull()).select(*keys, F.col(score).alias("s"), F.col(label).cast("double").alias("y"))
    inside = F.col("s").between(0.0, 1.0)
    binned = rows.groupBy(*keys, F.when(inside, calibration_bin(F.col("s"), bins)).alias("bin")).agg(F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("y").alias("y"))
    gap = F.when(F.col("bin").isNotNull(), F.col("s") - F.col("y")).otherwise(0.0)
    n = F.sum("k")
    return binned.groupBy(*keys).agg(n.alias("n"), (F.sum("y") / n).alias("base_rate"), (F.sum(F.abs(gap)) / n).alias("ece"), (F.sum(gap) / n).alias("signed_gap"))


def raw_prevalence(ap: Column, se: Column, sp: Column) -> Column:
    """The correction before clipping; null where the test tells nothing."""
    j = se + sp - 1
    return F.when(j > 0, F.try_divide(ap + sp - 1, j))


def rogan_gladen(ap: Column, se: Column, sp: Column) -> Column:
    """Corrected prevalence in [0, 1]; null where the test tells nothing (STA-12)."""
    return clip(raw_prevalence(ap, se, sp))


def correction_status(raw: Column) -> Column:
    """STA-14; a negative raw value is estimable, as zero."""
    return F.when(raw.isNull(), "undefined").when(raw > 1, "out of range").otherwise("estimable")
