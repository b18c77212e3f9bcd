"""SentencePiece encoding and decoding by a table of distinct chunks.

A model whose pieces hold the whitespace marker only at their front can never
merge across the place where a marker follows another character, and a
character that stands in no longer piece is a border on both sides. Texts are
cut there into marked words; each distinct word is segmented once, and its ids
are joined back by position. Word occurrences are never shuffled: the table is
kept by each worker and bounded (``TABLE_WORDS``), so work and memory follow
the texts at hand and a lost executor loses nothing but a cache.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as spec

from calibrant.llm._arrow import field, map_text, small_batches

MARK = "▁"
#: Distinct words that a worker remembers before it starts anew.
TABLE_WORDS = 250_000


class Codec:
    """Encodes and decodes exactly as the library does without begin or end ids."""

    def __init__(self, model_path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        model = spec.ModelProto()
        with open(model_path, "rb") as file:
            model.ParseFromString(file.read())
        self.separable = self._separable(model)
        self.words = re.compile(r" *[^ \n]+|\n| +")
        digits = [b"%d," % i for i in range(len(model.pieces))]
        #: Row i: the bytes of "i,", filled up with zeros.
        self.digits = np.array(digits, dtype=f"S{max(map(len, digits))}").view(np.uint8).reshape(len(digits), -1)
        self.widths = np.array([len(d) for d in digits])
        #: An encoding of a line feed and a word is that of the line feed and that of the word.
        self.skip = len(self.library.encode("\n")) if self.separable else 0
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.pool, self.begins, self.lengths = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    @staticmethod
    def _separable(model: spec.ModelProto) -> bool:
        """Whether pieces provably stay within marked words."""
        norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        plain = norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not norm.precompiled_charsmap
        whole = all(not re.search(f"[^{MARK}]{MARK}", p.piece) and (len(p.piece) == 1 or "\n" not in p.piece) for p in model.pieces if p.type in (1, 4, 5))
        return bool(plain and whole and model.trainer_spec.model_type == spec.TrainerSpec.BPE and not model.trainer_spec.treat_whitespace_as_suffix and spec.ModelProto.SentencePiece.USER_DEFINED not in kinds)

    def split(self, text: str) -> list[str]:
        """Marked words of a text, with the prefix that the model adds."""
        return self.words.findall(" " + text.replace(MARK, " ")) if text else []

    def learn(self, words: set[str]) -> None:
        """Segment words that the table lacks."""
        new = [w for w in words if w not in self.slots]
        if len(self.slots) + len(new) > TABLE_WORDS:
            self.forget()
            new = list(words)
        if not new:
            return
        coded = self.library.encode(["\n" + w for w in new], num_threads=1)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), np.int32, int(lengths.sum()))
        begins = np.cumsum(lengths) - lengths + self.skip + len(self.pool)
        self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new)), strict=True))
        self.pool = np.concatenate([self.pool, flat])
        self.begins = np.concatenate([self.begins, begins])
        self.lengths = np.concatenate([self.lengths, lengths - self.skip])

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and each text's end among them."""
        if not self.separable:
            coded = self.library.encode(texts, num_threads=1)
            ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
            return np.fromiter(chain.from_iterable(coded), np.int32), ends
        words = [self.split(t) for t in texts]
        flat = list(chain.from_iterable(words))
        self.learn(set(flat))
        slots = np.fromiter(map(self.slots.__getitem__, flat), np.int64, len(flat))
        lengths = self.lengths[slots]
        total = np.cumsum(lengths)
        places = np.repeat(self.begins[slots] - (total - lengths), lengths) + np.arange(int(total[-1]) if len(total) else 0)
        last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        return self.pool[places], np.concatenate([[0], total])[last]

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, ends = self.encode_flat(texts)
        flat = ids.tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if texts else []

    def encode_digits(self, texts: list[str]) -> tuple[list[list[int]], list[bytes]]:
        """For each text its ids, and the same as decimal digits joined by commas."""
        ids, ends = self.encode_flat(texts)
        rows = self.digits[ids].ravel()
        digits = rows[rows != 0].tobytes()
        places = np.concatenate([[0], np.cumsum(self.widths[ids])])[np.concatenate([[0], ends])].tolist()
        flat, stops = ids.tolist(), [0, *ends.tolist()]
        return [flat[a:b] for a, b in zip(stops, stops[1:], strict=False)], [digits[a : max(a, b - 1)] for a, b in zip(places, places[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


@lru_cache(maxsize=2)
def codec(model_path: str) -> Codec:
    return Codec(model_path)


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append the token ids of ``text`` as array<int> in column ``ids``.

    Null counts as empty and gives an empty array; rows, ties and repeats stay as
    they are; other columns pass through (one named like ``ids`` is replaced).
    """

    def kernel(texts: list) -> list:
        return [codec(model_path).encode([(t or b"").decode() for t in texts])]

    return map_text(df, text, kernel, [field(ids, "array<int>")])


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Append the text that the ids of each row decode to; null ids give null."""

    small_batches(df.sparkSession)

    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else codec(model_path).decode([int(i) for i in x]))

    return df.withColumn(text, F.pandas_udf(run, "string")(F.col(ids)))


def round_trip(df: DataFrame, model_path: str, text: str = "text", result: str = "text") -> DataFrame:
    """Replace ``text`` by what its ids decode to, in one pass (null stays null)."""

    def kernel(texts: list) -> list:
        own = codec(model_path)
        coded = own.encode([(t or b"").decode() for t in texts])
        return [[None if t is None else own.decode(i) for t, i in zip(texts, coded, strict=True)]]

    return map_text(df, text, kernel, [field(result, "string")])


def digests(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Encode and decode; append n_tokens, ids_sha256 and decoded_sha256, drop the text.

    Null counts as empty: no tokens, both digests those of the empty string.
    """

    def kernel(texts: list) -> list:
        own = codec(model_path)
        coded, digits = own.encode_digits([(t or b"").decode() for t in texts])
        return [
            [len(ids) for ids in coded],
            [hashlib.sha256(d).hexdigest() for d in digits],
            [hashlib.sha256(own.decode(ids).encode()).hexdigest() for ids in coded],
        ]

    return map_text(df, text, kernel, [field("n_tokens", "long"), field("ids_sha256", "string"), field("decoded_sha256", "string")], drop=(text,))
