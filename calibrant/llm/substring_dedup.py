"""Exact removal of repeated passages by seed and extend.

A passage of ``window`` words has ``window - ANCHOR + 1`` runs of ``ANCHOR``
words; the one with the lowest hash (the last of equals) is its seed, so equal
passages share a seed at one offset, and every passage belongs to one seed.

1. Seeds of all texts are counted; those met once are dropped.
2. At each remaining seed, the text is extended both ways: every passage that
   belongs to the seed is one pair of extensions, told by its hash. Seeds travel
   with their passages' hashes and meet by their own hash.
3. A passage met again at its seed is a repeat; runs of repeats are joined into
   maximal ones, gathered by text, and their words removed.

Work is linear in the words: no pairs are made, however many copies there are.
Texts are told by a 128-bit hash of their content, so copies share their
repeats. Seeds with more than a bounded number of places are counted passage by
passage: what a block of texts repeats by itself is settled there, the rest is
pre-aggregated and joined (skewed joins split) rather than gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.llm import _bytes
from calibrant.llm._arrow import blocks, field, map_text, small_batches, unused
from calibrant.llm._state import keep

#: Words of a passage, and of the runs among which its seed is chosen.
WINDOW, ANCHOR = 35, 12
#: Bits of the table that tells tasks which seeds may be met twice (8 MB; others' passages need not travel).
FILTER_BITS = 26
#: Places of a seed from which on it is counted passage by passage, whatever the input's size; a list of
#: up to so many such seeds is broadcast (8 MB), a longer one is joined.
HEAVY_PLACES, HEAVY_SEEDS = 1000, 1_000_000

_U = np.uint64
#: Kinds of rows that tasks hand on: a seed with its passages; of heavy seeds a passage
#: met once in its block, one met more often there, and a span known to repeat.
LIGHT, ASKED, TOLD, SPAN = range(4)


def _runs(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of neighbouring places in one row."""
    if not len(row):
        none = np.empty(0, np.int64)
        return none, none
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)])
    begins = np.flatnonzero(fresh)
    return begins, np.concatenate([begins[1:], [len(row)]]) - 1


def seeds(text: bytes, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed hash of each passage, its seed's place, passage hashes) for the passages in order."""
    words = _bytes.word_hashes(text)
    n = len(words) - window + 1
    if n <= 0:
        none = np.empty(0, np.uint64)
        return none, np.empty(0, np.int64), none
    own = _bytes.window_hashes(words, anchor)
    reach = window - anchor + 1
    # the lowest of `reach` neighbours, by doubling; of equals the last
    best = np.arange(len(own))
    span = 1
    while span < reach:
        step = min(span, reach - span)
        right, left = best[step:], best[:-step]
        best = np.where(own[right] <= own[left], right, left)
        span += step
    best = best[:n]
    return own[best], best, _bytes.window_hashes(words, window)


def _text_key(df: DataFrame, text: str) -> DataFrame:
    """(h1, h2, text): a 128-bit hash of the content beside it."""
    value = F.col(f"`{text}`").cast("string")
    return df.select(F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2"), value.alias("text"))


def _bits(found: DataFrame) -> np.ndarray:
    """One bit for each possible value of a seed's low bits: set if a repeated seed has it."""
    slot = F.col("seed").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = found.select(F.shiftright(slot, 5).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(31)).cast("int")).alias("bit"))
    table = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2**21 rows at most
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().astype(np.uint32)
    return out


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def repeats(df: DataFrame, text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, heavy_places: int = HEAVY_PLACES, heavy_seeds: int = HEAVY_SEEDS) -> DataFrame:
    """One row (h1, h2, spans) for each text with repeats; spans are sorted word ranges, end exclusive."""
    if not 0 < anchor <= window:
        raise ValueError("an anchor has 1 to `window` words")
    spark = df.sparkSession
    small_batches(spark)
    keyed = _text_key(df, text)

    def only_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            for a, b in blocks([len(t) for t in texts]):
                parts = []
                for t in texts[a:b]:
                    own, place, _ = seeds(t, window, anchor)
                    if len(own):
                        parts.append(own[np.concatenate([[True], place[1:] != place[:-1]])])
                if parts:
                    yield pa.RecordBatch.from_arrays([_signed(np.concatenate(parts))], ["seed"])

    # a seed met once in all texts cannot have a repeat
    met = keep(keyed.select("text").mapInArrow(only_seeds, "seed long").groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"))
    hot_seeds = met.where(F.col("n") > heavy_places).select("seed")
    n_hot = hot_seeds.count()
    listed = n_hot <= heavy_seeds
    heavy = np.sort(np.array([r[0] for r in hot_seeds.toLocalIterator()] if listed else [], np.int64))
    shared = spark.sparkContext.broadcast((_bits(met), heavy))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = shared.value
        for batch in batches:
            texts = _texts(batch)
            h1, h2 = (batch.column(n).to_numpy() for n in ("h1", "h2"))
            for a, b in blocks([len(t) for t in texts]):
                out: list[list[np.ndarray]] = [[] for _ in range(6)]
                for i in range(a, b):
                    own, place, hashes = seeds(texts[i], window, anchor)
                    if not len(own):
                        continue
                    begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                    ends = np.concatenate([begins[1:], [len(own)]])
                    low = own[begins] & _U((1 << FILTER_BITS) - 1)
                    maybe = (bits[(low >> _U(5)).astype(np.int64)] >> (low & _U(31)).astype(np.uint32)) & np.uint32(1) > 0
                    if not maybe.any():
                        continue
                    first, last = begins[maybe], ends[maybe]
                    take = np.repeat(maybe, ends - begins)
                    k = len(first)
                    for column, values in zip(out, (own[first].view(np.int64), np.full(k, h1[i]), np.full(k, h2[i]), first, last - first, hashes[take].view(np.int64)), strict=True):
                        column.append(values)
                if out[0]:
                    yield from dealt(hot, *map(np.concatenate, out))

    kinds = pa.schema([("kind", pa.int8()), ("seed", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("passages", pa.list_(pa.int64()))])

    def dealt(hot: np.ndarray, seed: np.ndarray, k1: np.ndarray, k2: np.ndarray, first: np.ndarray, count: np.ndarray, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of a block: seeds to be gathered, and what is left to ask about heavy ones."""

        def rows(kind: int, at: np.ndarray, begin: np.ndarray, end: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            columns = [np.full(len(at), kind, np.int8), seed[at], k1[at], k2[at], begin.astype(np.int32), end.astype(np.int32)]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], schema=kinds)

        spots = np.searchsorted(hot, seed)
        is_hot = np.zeros(len(seed), bool) if not len(hot) else hot[np.minimum(spots, len(hot) - 1)] == seed
        light = np.flatnonzero(~is_hot)
        if len(light):
            yield rows(LIGHT, light, first[light], first[light], count[light], flat[np.repeat(~is_hot, count)])
        if not is_hot.any():
            return
        # a heavy seed's passage that the block itself repeats needs no answer; the block tells others of it once
        mine = np.repeat(is_hot, count)
        row = np.repeat(np.arange(len(seed)), count)[mine]
        place = (np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(flat)))[mine]
        value = flat[mine]
        key = _bytes.mix(value.view(np.uint64) ^ (seed[row].view(np.uint64) * _U(0x9E3779B97F4A7C15)))
        _, lead, group, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        again = times[group] > 1
        told = lead[times > 1]
        one = np.ones
        if len(told):
            yield rows(TOLD, row[told], place[told], place[told], one(len(told), np.int64), value[told])
            begins, ends = _runs(row[again], place[again])
            yield rows(SPAN, row[again][begins], place[again][begins], place[again][ends] + window, np.zeros(len(begins), np.int64), value[:0])
        if not again.all():
            yield rows(ASKED, row[~again], place[~again], place[~again], one(int((~again).sum()), np.int64), value[~again])

    placed = keep(keyed.mapInArrow(passages, "kind byte, seed long, h1 long, h2 long, first int, last int, passages array<long>"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Passages that occur twice at their seed; the rows come sorted by seed."""
        left: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            left = table if left is None else pa.concat_tables([left, table])
            if left.num_rows < 4096:
                continue
            seed = left.column("seed").to_numpy()
            cut = int(np.searchsorted(seed, seed[-1]))  # the last seed may go on
            if cut:
                yield found(left.slice(0, cut))
                left = left.slice(cut)
        if left is not None and left.num_rows:
            yield found(left)

    def found(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        lists = table.column("passages").combine_chunks()
        count = lists.value_lengths().to_numpy()
        flat = lists.flatten().to_numpy().view(np.uint64)
        seed = table.column("seed").to_numpy().view(np.uint64)
        row = np.repeat(np.arange(len(count)), count)
        key = _bytes.mix(flat ^ (seed[row] * _U(0x9E3779B97F4A7C15)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        place = np.repeat(table.column("first").to_numpy().astype(np.int64) - (np.cumsum(count) - count), count) + np.arange(len(flat))
        row, place = row[twice], place[twice]
        begins, ends = _runs(row, place)
        at = row[begins]
        return pa.RecordBatch.from_arrays([pa.array(table.column("h1").to_numpy()[at]), pa.array(table.column("h2").to_numpy()[at]), pa.array(place[begins].astype(np.int32)), pa.array((place[ends] + window).astype(np.int32))], ["h1", "h2", "begin", "end"])

    schema = "h1 long, h2 long, begin int, end int"
    light = placed.where(F.col("kind") == LIGHT).select("seed", "h1", "h2", "first", "passages")
    hot = light.limit(0)
    if not listed:  # blocks could not tell heavy seeds: their passages are taken apart here
        hot, light = light.join(hot_seeds, "seed", "left_semi"), light.join(hot_seeds, "seed", "left_anti")
    spans = light.repartition("seed").sortWithinPartitions("seed").mapInArrow(meet, schema)
    if n_hot:
        known = placed.where(F.col("kind") == SPAN).select("h1", "h2", F.col("first").alias("begin"), F.col("last").alias("end"))
        passage = F.col("passages")[0].alias("passage")
        asked = placed.where(F.col("kind") == ASKED).select("seed", passage, "h1", "h2", "first")
        told = placed.where(F.col("kind") == TOLD).select("seed", passage, F.lit(2).alias("n"))
        if not listed:
            asked = hot.select("seed", "h1", "h2", "first", F.posexplode("passages").alias("k", "passage")).select("seed", "passage", "h1", "h2", (F.col("first") + F.col("k")).alias("first"))
        told = asked.select("seed", "passage", F.lit(1).alias("n")).unionByName(told).groupBy("seed", "passage").agg(F.sum("n").alias("n"))
        again = told.where("n > 1").select("seed", "passage")
        answered = asked.join(again, ["seed", "passage"]).select("h1", "h2", F.col("first").alias("begin"), (F.col("first") + window).alias("end"))
        spans = spans.unionByName(known).unionByName(answered)
    gathered = spans.distinct().groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    return gathered


def _with_repeats(df: DataFrame, text: str, **options: int) -> DataFrame:
    """``df`` with one more column, the last: the spans of ``text`` by its content."""
    h1, h2, spans = unused(df, "h1", "h2", "spans")
    found = repeats(df, text, **options).toDF(h1, h2, spans)
    value = F.col(f"`{text}`").cast("string")
    marked = df.select("*", F.xxhash64(value).alias(h1), F.xxhash64(F.lit(1), value).alias(h2))
    return marked.join(found, [h1, h2], "left").drop(h1, h2)


def kept_words(text: bytes | None, spans: list | None) -> tuple[int, list[bytes]]:
    """The number of words, and those outside the (sorted) spans."""
    words = (text or b"").split()
    if not spans:
        return len(words), words
    out, at = [], 0
    for span in spans:
        a, b = span["begin"], span["end"]
        if a > at:
            out += words[at:a]
        at = max(at, b)
    return len(words), out + words[at:]


def digests(df: DataFrame, text: str = "text", **options: int) -> DataFrame:
    """Append n_words, n_removed and kept_sha256 (kept words joined by a space), drop the text.

    Null and empty texts have no words; texts shorter than a passage keep all of
    theirs; very long texts are read whole; of repeated texts nothing is left if they
    have a passage's length. Other columns of any name stay, but for those with the
    name of a result, which are replaced.
    """

    def kernel(texts: list, spans: list) -> list:
        rows = [kept_words(t, s) for t, s in zip(texts, spans, strict=True)]
        return [[n for n, _ in rows], [n - len(w) for n, w in rows], [hashlib.sha256(b" ".join(w)).hexdigest() for _, w in rows]]

    marked = _with_repeats(df, text, **options)
    spans = marked.columns[-1]
    return map_text(marked, text, kernel, [field("n_words", "long"), field("n_removed", "long"), field("kept_sha256", "string")], drop=(text, spans), also=(spans,))


def remove(df: DataFrame, text: str = "text", **options: int) -> DataFrame:
    """Replace ``text`` by its kept words, joined by a space; a text without repeats (or null) stays as it is, and so do all other columns."""

    def kernel(texts: list, spans: list) -> list:
        return [[t if not s else b" ".join(kept_words(t, s)[1]).decode() for t, s in zip(texts, spans, strict=True)]]

    marked = _with_repeats(df, text, **options)
    spans = marked.columns[-1]
    out = map_text(marked, text, kernel, [field(text, "string")], drop=(spans,), also=(spans,))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
