"""A judge that answers with a number, through a cache (DET-09, DET-15).

The remote model is a callable; offline there is a stub, which answers with the
share of rules that match. Refusals are null scores; too many of them fail the run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.detectors import rules
from calibrant.detectors.registry import Detector, register
from calibrant.functions.text import first_score, prompt, truncated
from calibrant.shipping import ship
from calibrant.sources.sinks import cache_key, cache_misses

TEMPLATE = "How likely was this {genre} written by a machine? Answer with a whole number from 0 to 100.\n\n{text}"
#: Share of missing answers, and consecutive transport errors, that end a run.
MOST_MISSING, MOST_ERRORS = 0.2, 20


def question(text: Column, genre: str = "text", template: str = TEMPLATE) -> Column:
    return prompt(template, genre=F.lit(genre), text=truncated(text))


def stub_answer(text: Column) -> Column:
    return F.round(100 * rules.heuristics(text)).cast("int").cast("string")


def ask(misses: DataFrame, answer: Callable[[str], str], text: str = "text", template: str = TEMPLATE) -> DataFrame:
    """(key, shard, raw) of the answers to new questions; twenty transport errors in a row fail the task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        errors = 0
        for frame in frames:
            raw = []
            for value in frame["asked"]:
                try:
                    raw.append(answer(value))
                    errors = 0
                except OSError:
                    errors += 1
                    if errors >= MOST_ERRORS:
                        raise
                    raw.append(None)
            yield pd.DataFrame({"key": frame["key"], "shard": frame["shard"], "raw": raw})

    ship(misses.sparkSession)
    asked = question(F.coalesce(F.col(text), F.lit("")), template=template)
    return misses.select("key", "shard", asked.alias("asked")).dropDuplicates(["key"]).mapInPandas(run, "key string, shard string, raw string")


def judged(texts: DataFrame, cache: DataFrame, answer: Callable[[str], str], model: str, template: str = TEMPLATE, most_missing: float = MOST_MISSING) -> tuple[DataFrame, DataFrame]:
    """(texts with score, new cache rows); too many missing scores are an error."""
    misses = cache_misses(texts, cache, model, template)
    fresh = ask(misses, answer, template=template).persist()
    known = cache.select("key", "raw").unionByName(fresh.select("key", "raw"))
    keyed = texts.withColumn("key", cache_key(model, template, F.col("text")))
    scored = keyed.join(known, "key", "left").withColumn("score", first_score(F.col("raw"))).drop("raw", "key")
    if not enough_answers(scored, most_missing):
        raise ValueError(f"more than {most_missing:.0%} of the answers are missing")
    return scored, fresh


def enough_answers(scored: DataFrame, most: float = MOST_MISSING) -> bool:
    """Whether no larger share of the answers is missing."""
    row = scored.agg(F.avg(F.col("score").isNull().cast("double")).alias("missing")).first()
    return (row["missing"] or 0.0) <= most


@register("llm_judge", "judge", "offline stub of a remote judge")
def _judge() -> Detector:
    return Detector("llm_judge", "stub/1", lambda t: first_score(stub_answer(t)), "judge")
