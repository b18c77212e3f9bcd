"""Prevalence corrected for measured error rates (STA-12..14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.functions import stats as S
from calibrant.operators.sampling import bootstrap_counts
from calibrant.plans.validity import CELL

#: Apparent prevalences that are corrected.
GRID = [0.05, 0.10, 0.20, 0.30, 0.40]


def corrected(df: DataFrame, floor: int = 100, grid: list[float] | None = None, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """Sensitivity, specificity and J with its bounds; for each apparent prevalence the raw and clipped estimate,

    the bounds of its resamples, their share that tells nothing, and its status (STA-13).
    """
    counts = S.score_counts(df, CELL, S.is_positive(), S.is_matched())
    sizes = counts.groupBy(*CELL).agg(F.sum("p").alias("np"), F.sum("n").alias("nn")).where((F.col("np") >= floor) & (F.col("nn") >= floor))
    point = S.operating_point(counts, CELL)
    rows = point.join(F.broadcast(sizes), CELL).select(*CELL, F.col("recall").alias("sensitivity"), (1 - F.col("fpr")).alias("specificity")).withColumn("youden_j", F.col("sensitivity") + F.col("specificity") - 1)
    se, sp = F.col("sensitivity"), F.col("specificity")
    draws = _resamples(counts, point, replicates, seed)
    bounds = [*_j_bounds()]
    for ap in grid or GRID:
        raw = S.raw_prevalence(F.lit(ap), se, sp)
        key = f"ap{round(ap * 100):02d}"
        rows = rows.withColumns({f"{key}_raw": raw, f"{key}_point": S.rogan_gladen(F.lit(ap), se, sp), f"{key}_status": S.correction_status(raw)})
        # percentiles pass over the resamples that tell nothing
        again = S.rogan_gladen(F.lit(ap), F.col("se"), F.col("sp"))
        bounds += [F.percentile(again, F.lit(0.025)).alias(f"{key}_lo"), F.percentile(again, F.lit(0.975)).alias(f"{key}_hi"), F.avg(again.isNull().cast("double")).alias(f"{key}_undefined")]
    return rows.join(draws.groupBy(*CELL).agg(*bounds), CELL, "left")


def _resamples(counts: DataFrame, point: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(detector, genre, replicate, se, sp): rates of resamples of both sides, the threshold held fixed."""
    above = F.col("score") >= F.col("threshold")
    at = counts.join(F.broadcast(point.select(*CELL, "threshold")), CELL)  # a row per cell
    parts = {"ph": F.when(above, F.col("p")), "pm": F.when(~above, F.col("p")), "nh": F.when(above, F.col("n")), "nm": F.when(~above, F.col("n"))}
    four = at.groupBy(*CELL).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in parts.items()])
    drawn = bootstrap_counts(four, CELL, list(parts), replicates, seed)
    return drawn.select(*CELL, "replicate", F.try_divide("ph", F.col("ph") + F.col("pm")).alias("se"), F.try_divide("nm", F.col("nh") + F.col("nm")).alias("sp"))


def _j_bounds() -> list:
    j = F.col("se") + F.col("sp") - 1
    low = F.percentile(j, F.lit(0.025))
    return [low.alias("j_lo"), F.percentile(j, F.lit(0.975)).alias("j_hi"), (low > 0).alias("informative")]


def long_form(df: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """One row per cell and apparent prevalence (AGG-25)."""
    names = [f"ap{round(ap * 100):02d}" for ap in grid or GRID]
    entries = F.array(*[F.struct(F.lit(n).alias("ap"), F.col(f"{n}_raw").alias("raw"), F.col(f"{n}_point").alias("point"), F.col(f"{n}_lo").alias("lo"), F.col(f"{n}_hi").alias("hi"), F.col(f"{n}_undefined").alias("undefined"), F.col(f"{n}_status").alias("status")) for n in names])
    return df.select(*CELL, "sensitivity", "specificity", "youden_j", F.explode(entries).alias("e")).select(*CELL, "sensitivity", "specificity", "youden_j", "e.*")


def status_counts(df: DataFrame) -> DataFrame:
    """Cells per apparent prevalence and status."""
    return long_form(df).groupBy("ap", "status").agg(F.count("*").alias("n"))


def interval(df: DataFrame, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """(detector, genre, j_lo, j_hi, informative): J over resamples with the threshold held fixed (STA-13)."""
    counts = S.score_counts(df, CELL, S.is_positive(), S.is_matched())
    return _resamples(counts, S.operating_point(counts, CELL), replicates, seed).groupBy(*CELL).agg(*_j_bounds())
