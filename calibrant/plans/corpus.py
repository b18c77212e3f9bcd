"""Corpus sets, freeze and profile (S1-S3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.functions import text as X
from calibrant.functions.structure import before_cutoff, utc
from calibrant.operators.relational import align, union_all
from calibrant.operators.sampling import allocate, match_lengths
from calibrant.schemas import CORPUS_COLUMNS

#: The cut-off before which no text was written by a model, and the least length.
CUTOFF, MIN_CHARS = "2022-11-30T00:00:00Z", 10


def pull_requests(prs: DataFrame) -> DataFrame:
    """PR bodies of agents, trailers gone."""
    return _texts(prs.where(F.col("body").isNotNull()), "pr_body", F.col("id"), F.col("body"), F.col("agent"), X.strip(F.replace("repo_url", F.lit("https://github.com/"), F.lit(""))))


def _texts(df: DataFrame, genre: str, ident, body, agent, repo) -> DataFrame:
    rows = df.select(ident.cast("string").alias("source_id"), F.lit(genre).alias("genre"), X.strip_trailers(F.coalesce(body, F.lit(""))).alias("b"), agent.alias("agent"), repo.alias("repo"))
    text = F.col("b.text")
    return rows.select("source_id", "genre", "agent", "repo", text.alias("text"), F.col("b.had_trailer").alias("had_trailer"), F.length(text).alias("n_chars"), X.n_lines(text).alias("n_lines"), X.has_boilerplate(text).alias("has_boilerplate")).where(F.col("n_chars") >= MIN_CHARS)


def human_commits(log: DataFrame) -> DataFrame:
    """Commits from before the cut-off, by both stamps: bots to N3, people to N1; merges go (FLT-05, FLT-09, PRJ-04)."""
    known = log.where(~F.col("is_merge") & before_cutoff(CUTOFF, utc(F.col("committed_at")), utc(F.col("authored_at"))))
    return known.select(F.col("sha").alias("source_id"), "genre", F.lit(None).cast("string").alias("agent"), "repo", "text", "n_chars", F.when(F.col("is_bot"), "N3").otherwise("N1").alias("set"))


def freeze(sets: list[DataFrame], per_cell: int = 5000, seed: int = 7, version: str = "v1", bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """(corpus, deficits): aligned sets, matched negatives from the uncapped pool, other rows capped per set and genre.

    Matched human rows are second copies with ``matched`` true; capped ones have
    false, other sets null.
    """
    pool = union_all(*[align(s, [*CORPUS_COLUMNS, "row_id"]) for s in sets])
    matched, deficits = match_lengths(pool.where("set = 'P'"), pool.where("set = 'N1'"), bins, seed=seed)
    capped = allocate(pool, per_cell, ["set", "genre"], seed=seed)
    flag = F.when(F.col("set") == "N1", F.lit(False))
    both = capped.withColumn("matched", flag).unionByName(matched.select(*pool.columns).withColumn("matched", F.lit(True)))
    return both.withColumn("corpus_version", F.lit(version)), deficits


def set_totals(corpus: DataFrame) -> DataFrame:
    """Texts per set and genre with row totals and the grand total (AGG-24)."""
    rows = corpus.select("set", "genre")
    counts = rows.groupBy("set", "genre").agg(F.count("*").alias("n"))
    totals = counts.rollup("set", "genre").agg(F.sum("n").alias("n"))
    return totals.select(F.coalesce("set", F.lit("all")).alias("set"), F.coalesce("genre", F.lit("all")).alias("genre"), "n")


def profile(prs: DataFrame) -> DataFrame:
    """Requests, repositories, window of observation, top share and lengths per agent (AGG-02..12)."""
    n = F.length(F.coalesce("body", F.lit("")))
    return prs.groupBy("agent").agg(
        F.count("*").alias("n"),
        F.count_distinct("repo").alias("repos"),
        F.min("created_at").alias("first"),
        F.max("created_at").alias("last"),
        F.round(100 * F.avg((n == 0).cast("double")), 1).alias("empty_pct"),
        F.percentile(n, F.lit(0.5)).cast("int").alias("median_chars"),
        F.count_if(X.has_boilerplate(F.col("body"))).alias("boilerplate"),
    )
