"""Word pairs of a corpus counted, ranked and looked up by blocks of texts.

A block counts its different pairs first. What travels is each block's different
pairs, once to the task that has all pairs of a context and once back, and for each
word of a text the place of its pair within the block. Words are told by 64 bits of
their hash, words after the same word by 48: two of a million would be taken for one
with a chance of 0.002.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.shipping import ship

#: Words of a block: some 200 MB of a Python worker.
WORDS = 2_500_000
Cut = Callable[[str | None], list[bytes]]


def squeezed(value: bytes) -> bytes:
    return len(value).to_bytes(8, "little") + pa.compress(value, "zstd", asbytes=True)


def unsqueezed(value: bytes) -> bytes:
    return pa.decompress(value[8:], int.from_bytes(value[:8], "little"), "zstd", asbytes=True)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays by their first bytes, second bytes and so on, compressed."""
    planes = [(a.dtype.str, np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) for a in arrays]
    return squeezed(pickle.dumps(planes, protocol=5))


def unpacked(value: bytes) -> list[np.ndarray]:
    kinds = [(np.dtype(t), b) for t, b in pickle.loads(unsqueezed(value))]
    return [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(t.itemsize, -1).T).view(t).reshape(-1) for t, b in kinds]


class Block:
    """Some texts: their rows, numbers of words, words by number, and the different words; number 0 is the empty one."""

    def __init__(self, name: str) -> None:
        self.name, self.rows, self.parts, self.size = name, [], [], 0
        self.table: dict[bytes, int] = defaultdict()
        self.table.default_factory = self.table.__len__
        self.table[b""]

    def add(self, row, words: list[bytes]) -> None:
        self.rows.append(row)
        self.parts.append(np.fromiter(map(self.table.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def named(self) -> str:
        """Its task and number, with a checksum: if a second reading found other texts, the two would not meet, which is an error."""
        return f"{self.name}.{zlib.crc32(pickle.dumps((self.rows, self.size)))}"

    def hashes(self) -> np.ndarray:
        return pd.util.hash_array(np.array(list(self.table), object), categorize=False)

    def lengths(self) -> np.ndarray:
        return np.fromiter(map(len, self.parts), np.int64, len(self.parts))

    def pairs(self, parts: int) -> tuple[np.ndarray, Iterator[tuple[int, bytes]]]:
        """(place of each word's pair among the different ones, their packed lists by part)."""
        after, n = np.concatenate([*self.parts, np.empty(0, np.int32)]), self.lengths()
        before = np.zeros_like(after)
        before[1:] = after[:-1]
        before[(np.cumsum(n) - n)[n > 0]] = 0
        hashed = self.hashes()
        order = np.argsort(hashed)
        places = np.empty(len(order), np.int64)
        places[order] = np.arange(len(order))
        hashed = hashed[order]
        found, own, counts = np.unique(places[before] * len(order) + places[after], return_inverse=True, return_counts=True)
        first, second = np.divmod(found, len(order))
        part = (hashed % np.uint64(parts)).astype(np.int64)[first]
        dealt = np.argsort(part, kind="stable")
        moved = np.empty(len(dealt), np.uint32)
        moved[dealt] = np.arange(len(dealt), dtype=np.uint32)
        first, second, counts, part = first[dealt], second[dealt], counts[dealt].astype(np.uint32), part[dealt]

        def lists() -> Iterator[tuple[int, bytes]]:
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                contexts, sizes = np.unique(first[low:high], return_counts=True)
                yield int(part[low]), packed(hashed[contexts], sizes.astype(np.uint32), _low48(hashed[second[low:high]]), counts[low:high])

        return moved[own], lists()


def _low48(values: np.ndarray) -> np.ndarray:
    """The upper six bytes of each hash."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, 2:]).reshape(-1)


def _from48(values: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(values) // 6, 8), np.uint8)
    wide[:, :6] = values.reshape(-1, 6)
    return wide.view(np.uint64).reshape(-1)


def blocks(batches: Iterator[pa.RecordBatch], cut: Cut) -> Iterator[Block]:
    """Blocks of the (row, text) batches of a task, named by it and their number."""
    task = TaskContext.get().partitionId()
    number, block = 0, Block(f"{task}.0")
    for batch in batches:
        for row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            block.add(row, cut(value))
            if block.size >= WORDS:
                yield block
                number += 1
                block = Block(f"{task}.{number}")
    if block.rows:
        yield block


def words(corpus: DataFrame, cut: Cut) -> int:
    """How many different words there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, cut):
            yield pa.RecordBatch.from_arrays([pa.array(block.hashes()[1:].view(np.int64))], ["h"])

    ship(corpus.sparkSession)
    return corpus.mapInArrow(run, "h long").distinct().count()


def ranked(blobs: list[list[np.ndarray]], v: int, alpha: float, ranks: bool = True) -> Iterator[bytes]:
    """For each block's packed list: sizes of the contexts, their totals, means and variances; counts and, if asked for, ranks of the pairs."""
    context = np.concatenate([np.repeat(h, m) for h, m, _, _ in blobs])
    token = np.concatenate([_from48(t) for _, _, t, _ in blobs])
    counts = np.concatenate([c for *_, c in blobs]).astype(np.int64)
    order = np.lexsort((token, context))
    context, token = context[order], token[order]
    new_context = np.diff(context, prepend=~context[:1]) != 0
    new = new_context | (np.diff(token, prepend=~token[:1]) != 0)
    at = np.flatnonzero(new)
    n = np.add.reduceat(counts[order], at)
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new_context[at])
    of = np.cumsum(new_context[at]) - 1
    names, total, seen = context[at[starts]], np.add.reduceat(n, starts), np.diff(starts, append=len(at))
    p = (n + alpha) / (total + alpha * v)[of]
    q, mass = alpha / (total + alpha * v), np.maximum(v - seen, 0)
    mu = np.add.reduceat(p * np.log(p), starts) + mass * q * np.log(q)
    var = np.add.reduceat(p * np.log(p) ** 2, starts) + mass * q * np.log(q) ** 2 - mu * mu
    falling = np.lexsort((-n, of))
    tied = (np.diff(n[falling], prepend=-1) != 0) | (np.diff(of[falling], prepend=-1) != 0)
    rank = np.empty(len(n), np.int64)
    rank[falling] = np.maximum.accumulate(np.where(tied, np.arange(len(n)), 0)) - starts[of[falling]] + 1
    low = 0
    for h, m, _, c in blobs:
        own, ours = np.searchsorted(names, h), pair[low : low + len(c)]
        low += len(c)
        yield packed(m, total[own], mu[own], var[own], n[ours].astype(np.uint32), *[rank[ours].astype(np.uint32)] * ranks)


def looked_up(corpus: DataFrame, cut: Cut, v: int, alpha: float, told: Callable, schema: str, ranks: bool = True) -> DataFrame:
    """``told(rows, lengths, places, values)`` of every block: for each text in turn its number of words and their places among the block's pairs,
    ascending; ``values`` are the joined arrays of ``ranked``; the corpus is (row, text) and read twice, in the same splits."""
    parts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, cut):
            lists = list(block.pairs(parts)[1])
            yield pa.RecordBatch.from_arrays([pa.array([block.named()] * len(lists), pa.string()), pa.array([k for k, _ in lists], pa.int32()), pa.array([x for _, x in lists], pa.binary())], ["block", "part", "data"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, cut):
            kept = packed(*stepped(block.lengths(), block.pairs(parts)[0]))
            yield pa.RecordBatch.from_arrays([pa.array([block.named()]), pa.array([pickle.dumps((block.rows, kept))], pa.binary())], ["block", "data"])

    def count(group: pa.Table) -> pa.Table:
        blobs = [unpacked(x) for x in group["data"].to_pylist()]
        return pa.table({"block": group["block"], "part": group["part"], "data": pa.array(ranked(blobs, v, alpha, ranks), pa.binary())})

    def finish(sent: pa.Table, held: pa.Table) -> pa.Table:
        if held.num_rows != 1:
            raise ValueError("the texts changed between two readings")
        rows, kept = pickle.loads(held["data"][0].as_py())
        data = dict(zip(sent["part"].to_pylist(), sent["data"].to_pylist(), strict=True))
        lists = [unpacked(data[k]) for k in sorted(data)] or [[np.empty(0, np.int64)] * 6]
        return told(rows, *unstepped(*unpacked(kept)), [np.concatenate(x) for x in zip(*lists, strict=True)])

    ship(corpus.sparkSession)
    kind = "block string, part int, data binary"
    back = corpus.mapInArrow(send, kind).groupBy("part").applyInArrow(count, kind)
    held = corpus.mapInArrow(keep, "block string, data binary")
    return back.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(finish, schema)


def stepped(lengths: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, steps): a text's places in ascending order, each as its step from the one before; as only sums over a text are made of them,
    their order is not kept, and steps have fewer bits than places."""
    text = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    order = np.sort(text << 32 | places)
    steps = np.diff(order, prepend=0)
    first = (np.cumsum(lengths) - lengths)[lengths > 0]
    steps[first] = order[first] & 0xFFFFFFFF
    return lengths.astype(np.uint32), steps.astype(np.uint32)


def unstepped(lengths: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = lengths.astype(np.int64)
    sums = np.cumsum(steps, dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    before = np.append(0, sums)[first]
    return lengths, sums - np.repeat(before, lengths)
