"""Likelihood statistics over a pluggable language model (DET-05..08, DET-10, DET-16).

The formulas take token statistics from any scorer. The scorer shipped here is
an add-alpha bigram model over words that Spark counts from the corpus itself:
its context table grows with the corpus and is joined, never collected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from calibrant.detectors import blocks, spaced
from calibrant.shipping import ship

ALPHA = 0.5
#: White space as Spark's patterns have it: the copies' pairs must be those of the model.
_WORDS = re.compile(rb"[^\t\n\f\r ]+")
_PIECES = re.compile(r"[ \t\n\x0b\f\r]+|[^ \t\n\x0b\f\r]+")


def tokens(corpus: DataFrame, text: str = "text") -> DataFrame:
    """(row_id, pos, prev, token): lower-cased words with the word before (empty at the start)."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    shifted = F.concat(F.array(F.lit("")), words)
    pairs = F.arrays_zip(F.slice(shifted, 1, F.greatest(F.size(words), F.lit(0))).alias("prev"), words.alias("token"))
    return corpus.select("row_id", F.posexplode(pairs).alias("pos", "t")).select("row_id", "pos", "t.prev", "t.token")


def bigram_model(stream: DataFrame, alpha: float = ALPHA) -> tuple[DataFrame, DataFrame]:
    """(pairs, contexts) with counts, ranks, and each context's log-probability mean, variance and cross-entropy.

    A context's distribution is its seen tokens plus one mass for all unseen ones,
    spread evenly over the vocabulary.
    """
    vocabulary = stream.agg(F.count_distinct("token").alias("v"))  # one row
    pairs = stream.groupBy("prev", "token").agg(F.count("*").alias("n"))
    totals = pairs.groupBy("prev").agg(F.sum("n").alias("total"), F.count("*").alias("seen"))
    contexts = totals.crossJoin(F.broadcast(vocabulary))
    p = (F.col("n") + alpha) / (F.col("total") + alpha * F.col("v"))
    # a context has few distinct counts, however many tokens follow it
    higher = Window.partitionBy("prev").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = pairs.groupBy("prev", "n").agg(F.count("*").alias("tied")).select("prev", "n", (1 + F.coalesce(F.sum("tied").over(higher), F.lit(0))).alias("rank"))
    joined = pairs.join(ranks, ["prev", "n"]).join(contexts, "prev").withColumn("p", p)
    unseen = F.lit(alpha) / (F.col("total") + alpha * F.col("v"))
    mass = F.greatest(F.col("v") - F.col("seen"), F.lit(0))
    moments = joined.groupBy("prev", "total", "seen", "v").agg(F.sum(F.col("p") * F.log("p")).alias("m1"), F.sum(F.col("p") * F.log("p") * F.log("p")).alias("m2"))
    mu = F.col("m1") + mass * unseen * F.log(unseen)
    second = F.col("m2") + mass * unseen * F.log(unseen) * F.log(unseen)
    stats = moments.select("prev", mu.alias("mu"), (second - mu * mu).alias("var"))
    return joined.select("prev", "token", F.log("p").alias("logp"), "rank"), stats


def token_stats(stream: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(row_id, logp, mu, var, log_rank, n_tokens) of each text under the bigram model of the stream (DET-10)."""
    pairs, contexts = bigram_model(stream, alpha)
    # texts repeat pairs: count them before meeting the model
    own = stream.groupBy("row_id", "prev", "token").agg(F.count("*").alias("k"))
    joined = own.join(pairs, ["prev", "token"]).join(contexts, "prev")
    k = F.col("k")
    return joined.groupBy("row_id").agg(F.sum(k * F.col("logp")).alias("logp"), F.sum(k * F.col("mu")).alias("mu"), F.sum(k * F.col("var")).alias("var"), F.sum(k * F.log("rank")).alias("log_rank"), F.sum(k).alias("n_tokens"))


def cut_words(value: str | None) -> list[bytes]:
    """Lower-cased words as DuckDB has them: case is changed letter by letter, and \\x0b is no white space."""
    value = value or ""
    if not value.isascii():
        value = value.replace("\u0130", "i").replace("\u03a3", "\u03c3")
    lower = value.lower().encode("utf-8", "surrogatepass")
    return _WORDS.findall(lower) if b"\x0b" in lower else lower.split()


def text_stats(corpus: DataFrame, text: str = "text", alpha: float = ALPHA, ranks: bool = True) -> DataFrame:
    """``token_stats`` of ``corpus``, by blocks of texts: no row per word is shuffled. Without ``ranks`` there is no log_rank."""
    own = corpus.select("row_id", text)
    kind = own.schema["row_id"].dataType
    v = blocks.words(own, cut_words)
    arrow = to_arrow_type(kind)

    def told(rows: list, lengths: np.ndarray, places: np.ndarray, values: list[np.ndarray]) -> pa.Table:
        sizes, total, mu, var, n, *rank = values
        of = np.repeat(np.arange(len(sizes)), sizes)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        full = np.flatnonzero(lengths)
        each = {"logp": np.log((n + alpha) / (total + alpha * v)[of]), "mu": mu[of], "var": var[of]} | ({"log_rank": np.log(rank[0])} if ranks else {})
        sums = {k: np.bincount(doc, x[places], len(lengths))[full] for k, x in each.items()}
        return pa.table({"row_id": pa.array([rows[i] for i in full.tolist()], arrow), **sums, "n_tokens": lengths[full]})

    schema = f"row_id {kind.simpleString()}, logp double, mu double, var double, {'log_rank double, ' if ranks else ''}n_tokens long"
    return blocks.looked_up(own, cut_words, v, alpha, told, schema, ranks)


def curvature(logp: Column, mu: Column, var: Column) -> Column:
    """(sum log p - sum of means) over the root of the summed variances, which is at least 1e-6 (DET-05)."""
    return (logp - mu) / F.sqrt(F.greatest(var, F.lit(1e-6)))


def binoculars(nll: Column, cross_entropy: Column) -> Column:
    """Minus the ratio of observed loss and cross-entropy (DET-06)."""
    return -F.try_divide(nll, cross_entropy)


def npr(perturbed: Column, base: Column) -> Column:
    """Mean log rank of the perturbed copies over that of the text; null if the latter is zero (DET-07)."""
    return F.when(base > 0, perturbed / F.greatest(base, F.lit(1e-6)))


def spaced_pairs(corpus: DataFrame, text: str = "text") -> DataFrame:
    """(row_id, prev, token, weight): like ``tokens``, but runs of white space are tokens too; the weights of a text add up to one."""
    pieces = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"\s+|\S+"), F.lit(0))
    before = F.slice(F.concat(F.array(F.lit("")), pieces), F.lit(1), F.size(pieces))
    each = corpus.select("row_id", F.try_divide(F.lit(1.0), F.size(pieces)).alias("weight"), F.explode(F.arrays_zip(before.alias("prev"), pieces.alias("token"))).alias("t"))
    return each.select("row_id", "t.prev", "t.token", "weight")


def perturbed_pairs(corpus: DataFrame, copies: int = 50, text: str = "text") -> DataFrame:
    """``spaced_pairs`` of all perturbed copies, each text's counted together: rows follow its different pairs, not the copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                weights: dict[tuple[str, str], float] = {}
                for copy in perturbed(value, copies):
                    pieces = _PIECES.findall(copy.lower())
                    for pair, n in Counter(zip(["", *pieces], pieces, strict=False)).items():
                        weights[pair] = weights.get(pair, 0.0) + n / len(pieces)
                if weights:
                    before, after = zip(*weights, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.repeat(row, len(weights)), pa.array(before), pa.array(after), pa.array(weights.values())], ["row_id", "prev", "token", "weight"])

    own = corpus.select("row_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = own.schema["row_id"].dataType.simpleString()
    return own.mapInArrow(run, f"row_id {kind}, prev string, token string, weight double")


def perturbed_npr(corpus: DataFrame, copies: int = 50, text: str = "text") -> DataFrame:
    """(row_id, score): mean log rank of the perturbed copies over that of the text (DET-07).

    The bigram model is counted from the unperturbed texts, with white space as
    tokens, as that is all that the perturbations add. Tied tokens have the best of
    their ranks: an unseen one comes after all seen ones, in an unseen context all are first.
    """
    told = spaced.log_ranks(corpus.select("row_id", text), copies)
    told = joined_log_ranks(corpus, copies, text) if told is None else told
    return told.select("row_id", npr(F.col("perturbed") / copies, F.col("base")).alias("score"))


def joined_log_ranks(corpus: DataFrame, copies: int = 50, text: str = "text") -> DataFrame:
    """``spaced.log_ranks`` by joins, a row per pair: for corpora with more different runs of white space than its table may have."""
    own = spaced_pairs(corpus, text)
    pairs, _ = bigram_model(own)
    ranks = pairs.select("prev", "token", "rank")
    seen = ranks.groupBy("prev").agg(F.count("*").alias("seen"))

    def mean(stream: DataFrame, name: str) -> DataFrame:
        weights = stream.groupBy("row_id", "prev", "token").agg(F.sum("weight").alias("w"))
        rank = F.coalesce("rank", F.col("seen") + 1, F.lit(1))
        joined = weights.join(ranks, ["prev", "token"], "left").join(seen, "prev", "left")
        return joined.groupBy("row_id").agg(F.sum(F.col("w") * F.log(rank)).alias(name))

    perturbed = mean(perturbed_pairs(corpus, copies, text), "perturbed")
    return corpus.select("row_id").join(mean(own, "base"), "row_id", "left").join(perturbed, "row_id", "left")


def perturbed(value: str, copies: int, share: float = 0.5, spaces: int = 2) -> Iterator[str]:
    """The copies of a text, in order; all draws come from one source, seeded by the text."""
    draw = spaced.source(value)
    for mark, some in ((" ", copies // 2), ("\n", copies - copies // 2)):
        pieces = value.split(mark)
        for rows in spaced.extras(draw, ord(mark), some, len(pieces), share, spaces):
            for row in rows.tolist():
                yield mark.join([p + mark * n for p, n in zip(pieces, row, strict=True)])


def perturbations(corpus: DataFrame, copies: int = 50, share: float = 0.5, spaces: int = 2, text: str = "text") -> DataFrame:
    """(row_id, copy, text): spaces after half of the tokens in the first half of the copies, line feeds after half of the lines in the others (DET-08).

    Draws depend on the text and the copy's number alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = ([], [], []), 0
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for index, copy in enumerate(perturbed(value, copies, share, spaces)):
                    for held, x in zip(rows, (row, index, copy), strict=True):
                        held.append(x)
                    size += len(copy)
                    if size > 4_000_000:
                        yield told(rows)
                        rows, size = ([], [], []), 0
            if rows[0]:
                yield told(rows)

    def told(rows: tuple[list, list, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (arrow, pa.int32(), pa.string()), strict=True)], ["row_id", "copy", "text"])

    own = corpus.select("row_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    arrow = to_arrow_type(own.schema["row_id"].dataType)
    ship(corpus.sparkSession)
    return own.mapInArrow(run, f"row_id {own.schema['row_id'].dataType.simpleString()}, copy int, text string")
