"""Benchmark decontamination with a generalised suffix automaton.

The items' words become one automaton that recognises every run of words of
every item. Each document streams through it while the length of the longest
match that ends at the current word is tracked; a match as long as a window
marks the window's words and its items. Documents are never shuffled, and the
automaton is a broadcast of checked size: more items than ``BLOCK_WORDS`` words
are taken in several blocks, one pass over the documents each, checkpointed in
between, so that a worker holds one block's automaton at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import islice
from typing import Any

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.llm._arrow import field, map_text, unused
from calibrant.llm._state import keep

#: Words of an item that make a window; a shorter item is one window as a whole.
WINDOW = 8
#: Words of items in one automaton (about 400 bytes each in a worker).
BLOCK_WORDS = 500_000
#: Every byte outside 0-9, a-z (after lowering A-Z) and multi-byte characters separates words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text; null has none."""
    return text.translate(WORD_BYTES).split() if text else []


class SuffixAutomaton:
    """All runs of words of many items, with the items of each window."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, run in coded:
            last = 0
            for w in run:
                last = self._extend(last, w)
        n = len(self.link)
        #: The state on the way to the root that holds the last ``window`` words of a match.
        self.holder = [-1] * n
        order = sorted(range(n), key=self.longest.__getitem__)
        for v in order[1:]:
            if self.longest[v] >= window:
                self.holder[v] = v if self.longest[self.link[v]] < window else self.holder[self.link[v]]
        self.owners: dict[int, set[str | None]] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        self.least = window
        for name, run in coded:
            v = 0
            for i, w in enumerate(run):
                v = self.next[v][w]
                if i + 1 >= window:
                    self.owners.setdefault(self.holder[v], set()).add(name)
            if len(run) < window:
                self.short.setdefault(v, []).append((len(run), name))
                self.least = min(self.least, len(run))
        if self.short:  # short items end wherever a state below theirs is reached
            for v in order[1:]:
                if above := self.short.get(self.link[v]):
                    self.short[v] = [*self.short.get(v, []), *above]

    def _new(self, longest: int, link: int, step: dict[int, int]) -> int:
        self.longest.append(longest)
        self.link.append(link)
        self.next.append(step)
        return len(self.link) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state for what ``p`` and ``w`` make, apart from the longer runs of ``q``."""
        copy = self._new(self.longest[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        """Append a word to the run that ends in ``last``; the state of the longer run."""
        q = self.next[last].get(w)
        if q is not None:
            return q if self.longest[q] == self.longest[last] + 1 else self._split(last, q, w)
        made = self._new(self.longest[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = made
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[made] = q if self.longest[q] == self.longest[p] + 1 else self._split(p, q, w)
        return made

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Merged spans of words inside windows, and the items that own these windows."""
        get = self.ids.get
        codes = [get(w, -1) for w in words]
        spans: list[tuple[int, int]] = []
        owners: set[str | None] = set()
        known = np.fromiter(codes, np.int64, len(codes)) >= 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= self.least:
                self._walk(codes, a, b, spans, owners)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, owners

    def _walk(self, codes: list[int], a: int, b: int, spans: list, owners: set) -> None:
        step, link, longest, window, short = self.next, self.link, self.longest, self.window, self.short
        v = length = 0
        for i in range(a, b):
            w = codes[i]
            while v and w not in step[v]:
                v = link[v]
                length = longest[v]
            v = step[v].get(w, 0)
            length = length + 1 if v else 0
            if length >= window:
                owners |= self.owners.get(self.holder[v], set())
                self._mark(spans, i + 1 - window, i + 1)
            if short and v in short:
                for m, name in short[v]:
                    if m <= length:
                        owners.add(name)
                        self._mark(spans, i + 1 - m, i + 1)

    @staticmethod
    def _mark(spans: list, a: int, b: int) -> None:
        if spans and spans[-1][0] <= a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))


def _automaton(items: Broadcast, window: int) -> SuffixAutomaton:
    """The automaton of a broadcast block, built once per worker and kept beside the block."""
    built = items.__dict__.setdefault("_automata", {})
    if window not in built:
        built[window] = SuffixAutomaton(((n, words_of(t)) for n, t in items.value), window)
    return built[window]


def item_blocks(items: DataFrame, item: str, text: str, block_words: int = BLOCK_WORDS) -> Iterable[list[tuple[str | None, bytes]]]:
    """The items in blocks whose size is checked: at most ``block_words`` words by their hash, or one item."""
    own = items.select(F.col(item).cast("string").alias("name"), F.col(text).cast("binary").alias("text")).where(F.col(text).isNotNull()).distinct()
    total = own.agg(F.sum(F.length("text"))).first()[0] or 0
    # an upper bound: a word takes two bytes with its separator
    parts = max(1, -(-total // (2 * block_words)))
    for k in range(parts):
        chosen = own if parts == 1 else own.where(F.pmod(F.xxhash64("name", "text"), F.lit(parts)) == k)
        yield [(r["name"], bytes(r["text"])) for r in chosen.collect()]


def find(df: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Append n_words, hit_spans (word indexes, end exclusive) and hit_items (names).

    Null and empty texts have no words and no hits; an empty item table, null and
    wordless items hit nothing; an item without a name marks words but is not
    listed; repeated items count once. Rows and other columns pass through.
    """
    spark = df.sparkSession
    shared = None
    found = df.withColumns({"hit_spans": F.array().cast("array<struct<begin:int,end:int>>"), "hit_items": F.array().cast("array<string>")})
    for block in item_blocks(items, item, item_text, block_words):
        if shared is not None:  # the block before is done with, and its automata go
            found = keep(found)
            shared.destroy()
        shared = spark.sparkContext.broadcast(block)

        def kernel(texts: list, spans: list, names: list, shared: Any = shared) -> list:
            own = _automaton(shared, window)
            counts, out_spans, out_names = [], [], []
            for t, before, known in zip(texts, spans, names, strict=True):
                words = words_of(t)
                marked, owners = own.hits(words)
                if before:
                    marked = _merge(sorted([*marked, *((s["begin"], s["end"]) for s in before)]))
                counts.append(len(words))
                out_spans.append([{"begin": a, "end": b} for a, b in marked])
                out_names.append(sorted({*known, *(o for o in owners if o is not None)}))
            return [counts, out_spans, out_names]

        found = map_text(found, text, kernel, [field("n_words", "long"), field("hit_spans", "array<struct<begin:int,end:int>>"), field("hit_items", "array<string>")], also=("hit_spans", "hit_items"))
    return found


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words in ``spans`` and what stands between them."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORD_BYTES))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def clean(df: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = 0.8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Remove matched spans from ``text``; drop rows whose words are matched beyond ``coverage``.

    Removal goes on until no window is left, as it can join the words around a
    span. Null, empty and clean texts stay as they are; repeated rows are treated
    alike; columns stay the same, whatever their names.
    """
    blocks = iter(item_blocks(items, item, item_text, block_words))
    first = list(islice(blocks, 2))
    if len(first) > 1:
        return _clean_in_passes(df, items, text, item, item_text, window, coverage, block_words)
    shared = df.sparkSession.sparkContext.broadcast(first[0] if first else [])

    def kernel(texts: list) -> list:
        out, kept = [], []
        automaton = _automaton(shared, window)
        for t in texts:
            first = True
            good = True
            while good:
                words = words_of(t)
                spans = automaton.hits(words)[0]
                if not spans:
                    break
                if first and sum(b - a for a, b in spans) > coverage * len(words):
                    good = False
                t, first = cut(t, spans), False
            out.append(None if t is None else t.decode())
            kept.append(good)
        return [out, kept]

    (name,) = unused(df, "kept")
    marked = map_text(df, text, kernel, [field(text, "string"), field(name, "boolean")])
    return marked.where(F.col(name)).select(*[F.col(f"`{c}`") for c in df.columns])


def _clean_in_passes(df: DataFrame, items: DataFrame, text: str, item: str, item_text: str, window: int, coverage: float, block_words: int) -> DataFrame:
    """``clean`` for items of several blocks: spans of all blocks are found and cut in turns, of texts that had any last time."""
    names = df.columns
    own = [f"c{i}" for i in range(len(names))]
    rest = df.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)], F.col(f"`{text}`").cast("string").alias("body"))

    def cutting(texts: list, spans: list) -> list:
        return [[cut(t, [(s["begin"], s["end"]) for s in own]).decode() for t, own in zip(texts, spans, strict=True)]]

    settled: DataFrame | None = None
    while True:
        found = keep(find(rest, items, "body", item, item_text, window, block_words))
        hit = F.size("hit_spans") > 0
        done = found.where(~hit).select(*own, "body")
        marked = found.where(hit)
        if settled is None:
            covered = F.aggregate("hit_spans", F.lit(0), lambda n, s: n + s["end"] - s["begin"])
            marked = marked.where(covered <= coverage * F.col("n_words"))
        settled = done if settled is None else settled.unionByName(done)
        rest = keep(map_text(marked.select(*own, "body", "hit_spans"), "body", cutting, [field("body", "string")], drop=("hit_spans",), also=("hit_spans",)))
        if rest.isEmpty():
            break
    return settled.select(*[F.col("body" if c == text else o).alias(c) for c, o in zip(names, own, strict=True)])
