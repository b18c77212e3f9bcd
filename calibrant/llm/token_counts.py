"""Exact token counts of a byte-level BPE, huge documents piece by piece.

A huge document is encoded in overlapping chunks with offsets. The scan that
cuts a text into words only looks ahead, so two scans that both start a word at
one position go on alike from there. Neighbouring chunks are spliced at such a
common word start inside their overlap, where both scans are intact; if there
is none, the overlap grows, up to the rest of the document. Memory thus follows
the chunk, not the document, but for texts without any border.

Other documents are counted through words: no word of the scan continues from
a visible character into white space, so the stretches between such places
are counted alone, each distinct one once (a bounded table per worker).
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from calibrant.llm._arrow import field, map_text

#: Characters from which on a document is encoded in chunks, their length and first overlap.
HUGE, CHUNK, OVERLAP = 8_192, 8_192, 256
#: Distinct stretches that a worker remembers before it starts anew.
TABLE_WORDS = 400_000


class Counter:
    """Counts as the library does, special strings inside texts at its default."""

    def __init__(self, path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            own = json.load(file)
        pre = own["pre_tokenizer"] or {}
        added = own["added_tokens"]
        #: Only this scan, without a normaliser, has the properties that splicing rests on.
        self.byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and own["normalizer"] is None and own["model"]["type"] == "BPE" and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or re.search(r"\s", a["content"]) for a in added)
        self.longest_added = max([0, *(len(a["content"]) for a in added)])
        self.huge, self.chunk, self.overlap = huge, max(chunk, 2), max(overlap, 4 * self.longest_added)
        self.stretches = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
        self.odd_space = re.compile(r"[^\S \n]")
        self.table: dict[str, int] = {}
        self.widened = 0

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = [0] * len(texts)
        words: list[tuple[int, list[str]]] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            if self.byte_level and len(text) > self.huge:
                out[i] = self.spliced(text)
            elif self.byte_level and not self.odd_space.search(text):
                words.append((i, self.stretches.findall(text)))
            else:
                whole.append(i)
        for i, encoding in zip(whole, self.library.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = len(encoding)
        need = set().union(*(set(w) for _, w in words)) if words else set()
        new = [w for w in need if w not in self.table]
        if len(self.table) + len(new) > TABLE_WORDS:
            self.table.clear()
            new = list(need)
        for a in range(0, len(new), 10_000):
            part = new[a : a + 10_000]
            self.table.update(zip(part, map(len, self.library.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        get = self.table.__getitem__
        for i, own in words:
            out[i] = sum(map(get, own))
        return out

    def starts(self, text: str, at: int) -> tuple[dict[int, int], int]:
        """Word starts of a scan as {position in the document: tokens before it}, and all tokens."""
        encoding = self.library.encode(text, add_special_tokens=False)
        found: dict[int, int] = {}
        last = None
        offsets, words = encoding.offsets, encoding.word_ids
        for k, word in enumerate(words):
            # a special string has its own word of None or a fresh number
            if word != last or word is None:
                found.setdefault(at + offsets[k][0], k)
                last = word
        return found, len(words)

    def spliced(self, text: str) -> int:
        """Count by overlapping chunks; equal to one encoding of the whole text."""
        n, total, begin = len(text), 0, 0
        left, size = self.starts(text[: self.chunk], 0)
        base, stop = 0, min(self.chunk, n)  # tokens of the left scan before the splice; where its chunk ends
        while stop < n:
            overlap = self.overlap
            while True:
                start = max(stop - overlap, begin)
                right, right_size = self.starts(text[start : start + max(self.chunk, 2 * overlap)], start)
                right_stop = min(start + max(self.chunk, 2 * overlap), n)
                # common starts, clear of the chunks' ends by the length of a special string
                low, high = start + self.longest_added, stop - self.longest_added
                common = [p for p in right if low <= p < high and p > begin and p in left]
                if common:
                    break
                self.widened += 1
                if start == begin or overlap > n:
                    # no border in all of the left chunk: take a longer one
                    stop = min(n, stop + max(self.chunk, stop - begin))
                    left, size = self.starts(text[begin:stop], begin)
                    base = 0
                    if stop == n:
                        return total + size
                    overlap = self.overlap
                    continue
                overlap *= 2
            p = max(common)
            total += left[p] - base
            begin, left, size, base, stop = p, right, right_size, right[p], right_stop
        return total + size - base


@lru_cache(maxsize=4)
def counter(path: str, huge: int, chunk: int, overlap: int) -> Counter:
    return Counter(path, huge, chunk, overlap)


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 512, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Append n_bytes, n_tokens and over_limit (n_tokens > ``limit``), drop the text.

    Null counts as empty. Every other column and row passes through; a column
    with the name of a result is replaced.
    """

    def kernel(texts: list) -> list:
        n = counter(path, huge, chunk, overlap).count([(t or b"").decode() for t in texts])
        return [[len(t or b"") for t in texts], n, [x > limit for x in n]]

    return map_text(df, text, kernel, [field("n_bytes", "long"), field("n_tokens", "long"), field("over_limit", "boolean")], drop=(text,))
