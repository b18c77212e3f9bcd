"""Log ranks of texts and of their perturbed copies, by blocks of texts (DET-07, DET-08).

Perturbing adds white space and never touches a word, so a text's tokens are words
and the runs of white space in its gaps. All counts of a word, with the runs before and
after it, meet in one task; how many words follow a run how often is a small table, which
is read first and goes to all tasks. The copies are drawn beside the text, as gaps and not
as strings. Runs and words are told by 64 bits of a hash; a run's is a sum over its
stretches of equal characters, linear in their lengths, so an added character adds its term.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from calibrant.detectors.blocks import packed, squeezed, unpacked, unsqueezed
from calibrant.shipping import ship

#: Characters of a block, some million words.
CHARS = 6_000_000
#: Rows of the table of runs that go to the driver and to all tasks, some 20 MB at most.
RUNS = 500_000
#: Characters of the texts that are cut at once.
CACHED = 250_000
#: Words times runs up to which ranks are looked up in a full table.
DENSE = 4_000_000
#: Drawn extras of several copies that are held at once.
DRAWN = 1_000_000
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t\n\x0b\f\r")] = range(1, 7)


def _term(stretch: np.ndarray, kind: np.ndarray, add: int) -> np.ndarray:
    """64 random bits of a run's stretch number and its character: of each character (0), of the stretch itself (1)."""
    x = (np.atleast_1d(np.asarray(stretch, np.uint64)) * np.uint64(16) + np.asarray(kind, np.uint64) * np.uint64(2) + np.uint64(add + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = np.where(_KIND > 0, np.uint64(0), _term(np.arange(256) + 1_000, 0, 0))


class Gaps:
    """Words of some texts, lower-cased, and the runs before, between and after them: 64 bits each, zero for no run; a text has a gap more than words."""

    def __init__(self, texts: list[str]) -> None:
        lower = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(x) for x in lower])
        raw = np.frombuffer(b"".join(lower), np.uint8)
        first = np.zeros(len(raw) + 1, bool)
        first[ends - [len(x) for x in lower]] = True
        first, kind = first[:-1], _KIND[raw]
        blank = kind > 0
        follows = np.zeros(len(raw), bool)
        follows[1:] = blank[1:] == blank[:-1]
        opens = first | ~follows
        word_at = np.flatnonzero(opens & ~blank)
        self.words = self._hashed(raw, word_at)
        text = np.searchsorted(ends, word_at, "right")
        self.counts = np.bincount(text, minlength=len(texts))
        self.ends = np.cumsum(self.counts + 1)
        self.starts = self.ends - self.counts - 1
        at = np.flatnonzero(blank)
        self.kind, new = kind[at], opens[at]
        fresh = new.copy()
        fresh[1:] |= self.kind[1:] != self.kind[:-1]
        starts = np.flatnonzero(new)
        stretches, run = np.cumsum(fresh) - 1, np.cumsum(new) - 1
        self.stretch = stretches - stretches[starts][run]
        self.text = np.searchsorted(ends, at, "right")
        gap = np.searchsorted(word_at, at[starts]) + self.text[starts]
        self.of = gap[run]
        self.each = _term(self.stretch, self.kind, 0)
        self.hashes = np.zeros(self.ends[-1], np.uint64)
        if len(at):
            self.hashes[gap] = np.add.reduceat(self.each + np.where(fresh, _term(self.stretch, self.kind, 1), np.uint64(0)), starts)
        self.pieces = self.counts + np.bincount(self.text[starts], minlength=len(texts))

    @staticmethod
    def _hashed(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """64 bits of each word: a polynomial of random numbers for its bytes, mixed."""
        if not len(at):
            return np.empty(0, np.uint64)
        place = np.arange(at[0], len(raw)) - np.repeat(at, np.diff(at, append=len(raw)))
        powers = np.full(place.max() + 1, 0x9E6C63D0676A9A99, np.uint64)
        powers[0] = 1
        return _term(np.add.reduceat(_BYTES[raw[at[0] :]] * np.cumprod(powers)[place], at - at[0]), 0, 0)

    def marks(self, mark: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(gap, term of one more) of each ``mark`` and of the end of each text, the texts' bounds, and what a new stretch at each end adds."""
        kind = _KIND[mark]
        own = np.flatnonzero(self.kind == kind)
        last = np.full(len(self.counts), -1)
        last[self.text] = np.arange(len(self.text))
        ended = self.hashes[self.ends - 1] > 0
        at = last[ended]
        number, opened = np.zeros(len(ended), np.int64), np.ones(len(ended), bool)
        opened[ended] = self.kind[at] != kind
        number[ended] = self.stretch[at] + opened[ended]
        bounds = np.append(0, np.cumsum(np.bincount(self.text[own], minlength=len(ended)) + 1))
        of, each = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.uint64)
        place = np.arange(len(own)) + self.text[own]
        of[place], each[place] = self.of[own], self.each[own]
        of[bounds[1:] - 1], each[bounds[1:] - 1] = self.ends - 1, _term(number, kind, 0)
        return of, each, bounds, np.where(opened, _term(number, kind, 1), np.uint64(0))


def source(value: str) -> np.random.Generator:
    """The draws of a text's copies."""
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=8).digest(), "big"))


@cache
def _poisson(mean: float) -> np.ndarray:
    """Poisson chances of 0, 1 and so on, as far as doubles tell them from nothing."""
    chances = np.cumprod(np.append(np.exp(-mean), mean / np.arange(1, int(40 + 8 * mean))))
    return chances / chances.sum()


def extras(draw: np.random.Generator, mark: int, copies: int, pieces: int, share: float = 0.5, spaces: int = 2) -> Iterator[np.ndarray]:
    """How many ``mark`` follow each piece, some copies at a time: a share of the pieces has line feeds, one each, or spaces, one and a Poisson number."""
    size, step, poisson = int(pieces * share), max(1, DRAWN // pieces), _poisson(spaces)
    for low in range(0, copies, step):
        drawn = np.zeros((min(step, copies - low), pieces), np.int64)
        if size and mark == 32:  # how many have each number, as a shuffle follows
            times = draw.multinomial(size, poisson, len(drawn))
            drawn[:, :size] = np.repeat(np.tile(np.arange(1, len(poisson) + 1), len(drawn)), times.ravel()).reshape(len(drawn), size)
        elif size:
            drawn[:, :size] = 1
        if size:
            draw.permuted(drawn, axis=1, out=drawn)
        yield drawn


class Runs:
    """The table of runs: which there are, how often a text begins with each, and the ranks of counts among what follows each; run 0 is the start of a text."""

    def __init__(self, runs: np.ndarray, n: np.ndarray, k: np.ndarray) -> None:
        first = n == -2
        held = n > 0
        owner = np.concatenate([runs[held], np.zeros(first.sum(), np.uint64)])
        counts, tied = np.concatenate([n[held], k[first]]), np.concatenate([k[held], np.ones(first.sum(), np.int64)])
        self.runs = np.unique(np.append(runs, np.uint64(0)))
        self.keys, own = np.unique(np.searchsorted(self.runs, owner).astype(np.int64) << 40 | counts, return_inverse=True)
        tied = np.bincount(own, tied, len(self.keys)).astype(np.int64)
        of = self.keys >> 40
        self.seen = np.bincount(of, tied, len(self.runs)).astype(np.int64)
        self.ranks = np.cumsum(self.seen)[of] - np.cumsum(tied) + 1
        self.begun = np.zeros(len(self.runs), np.int64)
        self.begun[np.searchsorted(self.runs, runs[first])] = k[first]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.runs >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each run's number, or -1."""
        at = np.minimum(np.searchsorted(self.runs, hashes), len(self.runs) - 1)
        return np.where(self.runs[at] == hashes, at, -1)

    def rank(self, run: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.ranks[np.searchsorted(self.keys, run.astype(np.int64) << 40 | n)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list, list[str]]]:
    """(name, rows, texts) of each block: its task and number, with a checksum of what was read."""
    task, number = TaskContext.get().partitionId(), 0

    def named() -> str:
        return f"{task}.{number}.{zlib.crc32(pickle.dumps((rows, list(map(len, texts)))))}"

    rows, texts, size = [], [], 0
    for batch in batches:
        for row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows.append(row)
            texts.append(value or "")
            size += len(texts[-1])
            if size >= CHARS:
                yield named(), rows, texts
                rows, texts, size, number = [], [], 0, number + 1
    if rows:
        yield named(), rows, texts


def _placed(words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different words by part, their parts, place of each word among them)."""
    hashed, own = np.unique(words, return_inverse=True)
    part = (hashed % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    places = np.empty(len(order), np.int64)
    places[order] = np.arange(len(order))
    return hashed[order], part[order], places[own]


def _some(texts: list[str]) -> Iterator[list[str]]:
    """Few enough texts at a time that their bytes stay in the processor's cache."""
    low, size = 0, 0
    for i, value in enumerate(texts):
        size += len(value)
        if size >= CACHED or i == len(texts) - 1:
            yield texts[low : i + 1]
            low, size = i + 1, 0


def _joined(each: list[Gaps]) -> tuple[np.ndarray, ...]:
    """(words, hashes, pieces, starts, ends) of all texts."""
    ends = np.cumsum(np.concatenate([g.counts for g in each]) + 1)
    words, hashes, pieces, counts = (np.concatenate([getattr(g, k) for g in each]) for k in ("words", "hashes", "pieces", "counts"))
    return words, hashes, pieces, ends - counts - 1, ends


def _lists(texts: list[str], parts: int) -> Iterator[tuple[int, bytes]]:
    """By part, its words with the runs before and after each, counted; part 0 has also what the texts begin with."""
    words, hashes, _, starts, ends = _joined([Gaps(some) for some in _some(texts)])
    hashed, part, places = _placed(words, parts)
    runs, own = np.unique(hashes, return_inverse=True)
    before, after = np.ones(len(own), bool), np.ones(len(own), bool)
    before[ends - 1] = False
    after[starts] = False
    begun, times = np.unique(own[~after], return_counts=True)
    begun, times = begun[runs[begun] > 0], times[runs[begun] > 0]
    told = []
    for which in (before, after):
        key = places * len(runs) + own[which]
        key, counts = np.unique(key if which is before else key[runs[own[which]] > 0], return_counts=True)
        word, run = np.divmod(key, len(runs))
        told.append((np.bincount(word, minlength=len(hashed)), run, counts, np.searchsorted(word, np.arange(len(hashed) + 1))))
    edges = np.searchsorted(part, np.arange(parts + 1))
    for k in range(parts):
        low, high = edges[k], edges[k + 1]
        if low < high or k == 0:
            sides = [x.astype(np.uint32) for size, run, counts, at in told for x in (size[low:high], run[at[low] : at[high]], counts[at[low] : at[high]])]
            some = slice(None) if k == 0 else slice(0)
            yield k, packed(hashed[low:high], runs, *sides, runs[begun][some], times[some].astype(np.uint32))


def _merged(blobs: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(runs, word number of each list's words, (word, run, count) of the runs before and after) of a part's lists."""
    words, number = np.unique(np.concatenate([b[0] for b in blobs]), return_inverse=True)
    runs = np.unique(np.concatenate([b[1] for b in blobs]))
    edges = np.cumsum([len(b[0]) for b in blobs])[:-1]
    sides = []
    for i in (2, 5):
        run = np.concatenate([np.searchsorted(runs, b[1])[b[i + 1]] for b in blobs])
        key, own = np.unique(np.repeat(number, np.concatenate([b[i] for b in blobs])) * len(runs) + run, return_inverse=True)
        n = np.bincount(own, np.concatenate([b[i + 2] for b in blobs]), len(key)).astype(np.int64)
        sides.append((*np.divmod(key, len(runs)), n))
    return runs, np.split(number, edges), sides


def _tallied(blobs: list[list[np.ndarray]]) -> pa.Table:
    """(run, n, k): k words follow the run n times; n is -1 for a run there is, -2 for one that k texts begin with."""
    runs, _, ((_, run, n), _) = _merged(blobs)
    key, k = np.unique(run << 40 | n, return_counts=True)
    run, n = key >> 40, key & ((1 << 40) - 1)
    begun, times = np.concatenate([b[8] for b in blobs]), np.concatenate([b[9] for b in blobs])
    run = np.concatenate([runs[run], runs, begun])
    n = np.concatenate([n, np.full(len(runs), -1), np.full(len(begun), -2)])
    return pa.table({"run": run.view(np.int64), "n": n, "k": np.concatenate([k, np.ones(len(runs), np.int64), times.astype(np.int64)])})


def _answered(blobs: list[list[np.ndarray]]) -> Iterator[bytes]:
    """For each list: all runs met before and after each of its words, with the counts of the former and the ranks of the latter."""
    runs, numbers, ((left, before, n), (word, after, m)) = _merged(blobs)
    falling = np.lexsort((-m, word))
    tied = (np.diff(m[falling], prepend=-1) != 0) | (np.diff(word[falling], prepend=-1) != 0)
    rank = np.empty(len(m), np.int64)
    rank[falling] = np.maximum.accumulate(np.where(tied, np.arange(len(m)), 0)) - np.searchsorted(word, word[falling]) + 1
    for own in numbers:
        told = []
        for of, run, value in ((left, before, n), (word, after, rank)):
            low, high = np.searchsorted(of, own), np.searchsorted(of, own, "right")
            size = high - low
            at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
            told += [size.astype(np.uint32), run[at].astype(np.uint32), value[at]]
        yield packed(runs, *told)


def _copied(texts: list[str], gaps: Gaps, runs: Runs, copies: int, share: float, spaces: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]]]:
    """(weight of the copies that leave each gap alone, that of the others, (gap, run number, weight) where the others' run is one of the corpus)."""
    changed, hits, marks = np.zeros(len(gaps.hashes)), [], []
    for mark, some in ((32, copies // 2), (10, copies - copies // 2)):
        of, each, bounds, opened = gaps.marks(mark)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        marks.append((mark, some, each, bounds.tolist(), opened, starts, of[starts], np.searchsorted(starts, bounds).tolist()))
    totals = np.zeros(len(texts))
    bare = (gaps.hashes[gaps.ends - 1] == 0).tolist()
    for i, (value, pieces) in enumerate(zip(texts, gaps.pieces.tolist(), strict=True)):
        if not pieces:
            continue
        draw = source(value)
        for mark, some, each, bounds, opened, starts, groups, edges in marks:
            low, high = bounds[i], bounds[i + 1]
            if not int((high - low) * share):
                totals[i] += some / pieces
                continue
            group = groups[edges[i] : edges[i + 1]]
            first, own, lost = starts[edges[i] : edges[i + 1]] - low, gaps.hashes[group], np.zeros(len(group))
            for drawn in extras(draw, mark, some, high - low, share, spaces):
                ended = drawn[:, -1] > 0
                added = drawn.view(np.uint64)
                added *= each[low:high]
                if len(first) < high - low:
                    added = np.add.reduceat(added, first, axis=1)
                added[ended, -1] += opened[i]
                other = added != 0
                weight = 1.0 / (pieces + (ended if bare[i] else np.zeros(len(ended))))
                for longer in (False, True) if bare[i] else (None,):
                    rows = other if longer is None else other[ended == longer]
                    lost += np.add.reduce(rows.view(np.uint8), axis=0, dtype=np.uint32) / (pieces + bool(longer))
                totals[i] += weight.sum()
                added += own
                found = runs.filter[added >> np.uint64(44)]
                found &= other
                if found.any():
                    copy, at = np.nonzero(found)
                    run = runs.find(added[copy, at])
                    met = run >= 0
                    hits.append((group[at[met]], run[met], weight[copy[met]]))
            changed[group] += lost
    return np.repeat(totals, gaps.counts + 1) - changed, changed, hits


def _finished(texts: list[str], answers: dict[int, bytes], parts: int, runs: Runs, copies: int, share: float, spaces: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean log rank of each text, sum of those of its copies); NaN for texts without tokens."""
    each, weights, hits, low = [], [], [], 0
    for some in _some(texts):
        gaps = Gaps(some)
        *both, met = _copied(some, gaps, runs, copies, share, spaces)
        hits += [(gap + low, run, weight) for gap, run, weight in met]
        each.append(gaps)
        weights.append(both)
        low += len(gaps.hashes)
    words, hashes, pieces, starts, ends = _joined(each)
    whole, changed = map(np.concatenate, zip(*weights, strict=True))
    hashed, _, places = _placed(words, parts)
    left, right = np.full(len(hashes), -1), np.full(len(hashes), -1)
    first, last = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    first[starts], last[ends - 1] = True, True
    left[~first], right[~last] = places, places
    width = len(runs.runs)
    lists = [unpacked(answers[k]) for k in sorted(answers)]
    seen = np.concatenate([x[4] for x in lists]).astype(np.int64)
    sides = []
    for i in (1, 4):
        run = np.concatenate([np.searchsorted(runs.runs, x[0])[x[i + 1]] for x in lists])
        value = np.concatenate([x[i + 2] for x in lists])
        word = np.repeat(np.arange(len(hashed)), np.concatenate([x[i] for x in lists]))
        sides.append((word * width + run, np.log(runs.rank(run, value) if i == 1 else value)))
    unseen = np.append(np.log(seen + 1.0), np.log(runs.seen[0] + 1.0))  # the last for the start of a text

    def side(keys: np.ndarray, logs: np.ndarray, word: np.ndarray, run: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The log of each pair's rank, or ``other`` for pairs that the corpus has not."""
        if not len(keys):
            return other
        wanted = word * width + run
        if len(hashed) * width <= DENSE:
            table = np.full((len(hashed) + 1) * width, np.nan)
            table[keys] = logs
            found = table[wanted]
            return np.where(np.isnan(found), other, found)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, logs[at], other)

    def cost(left: np.ndarray, run: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Log rank of a gap's run after the word before it, and of the word after it."""
        told = side(*sides[1], left, run, unseen[left])
        begun = (left < 0) & (runs.begun[run] > 0)
        told[begun] = np.log(runs.rank(np.zeros(begun.sum(), np.int64), runs.begun[run[begun]]))
        return np.where(run > 0, told, 0.0) + np.where(right >= 0, side(*sides[0], right, run, np.log(runs.seen[run] + 1.0)), 0.0)

    own = cost(left, runs.find(hashes), right)
    sums = whole * own + changed * unseen[left]
    if hits:
        gap, run, weight = map(np.concatenate, zip(*hits, strict=True))
        sums += np.bincount(gap, weight * (cost(left[gap], run, right[gap]) - unseen[left[gap]]), len(sums))
    with np.errstate(invalid="ignore"):
        return np.add.reduceat(own, starts) / pieces, np.where(pieces > 0, np.add.reduceat(sums, starts), np.nan)


def log_ranks(corpus: DataFrame, copies: int, share: float = 0.5, spaces: int = 2) -> DataFrame | None:
    """(row_id, base, perturbed): a text's mean log rank and the sum of those of its copies, of (row, text); None if the table of runs is too long."""
    spark = corpus.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row, kind = corpus.columns[0], corpus.schema[0].dataType
    arrow = to_arrow_type(kind)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, texts in _blocks(batches):
            lists = list(_lists(texts, parts))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(lists), pa.string()), pa.array([k for k, _ in lists], pa.int32()), pa.array([x for _, x in lists], pa.binary())], ["block", "part", "data"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows, texts in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([squeezed(pickle.dumps((rows, texts), protocol=5))], pa.binary())], ["block", "data"])

    def tally(group: pa.Table) -> pa.Table:
        return _tallied([unpacked(x) for x in group["data"].to_pylist()])

    ship(spark)
    shape = "block string, part int, data binary"
    sent = corpus.mapInArrow(send, shape).checkpoint().groupBy("part")  # read twice
    table = sent.applyInArrow(tally, "run long, n long, k long").groupBy("run", "n").agg(F.sum("k").alias("k")).limit(RUNS + 1).toArrow()
    if table.num_rows > RUNS:
        return None
    runs = Runs(table["run"].to_numpy().view(np.uint64), table["n"].to_numpy(), table["k"].to_numpy())

    def answer(group: pa.Table) -> pa.Table:
        return pa.table({"block": group["block"], "part": group["part"], "data": pa.array(_answered([unpacked(x) for x in group["data"].to_pylist()]), pa.binary())})

    def finish(told: pa.Table, held: pa.Table) -> pa.Table:
        if held.num_rows != 1:
            raise ValueError("the texts changed between two readings")
        rows, texts = pickle.loads(unsqueezed(held["data"][0].as_py()))
        answers = dict(zip(told["part"].to_pylist(), told["data"].to_pylist(), strict=True))
        base, perturbed = _finished(texts, answers, parts, runs, copies, share, spaces)
        return pa.table({"row_id": pa.array(rows, arrow), "base": pa.array(base, from_pandas=True), "perturbed": pa.array(perturbed, from_pandas=True)})

    back = sent.applyInArrow(answer, shape)
    kept = corpus.select(F.col(row), F.col(corpus.columns[1])).mapInArrow(keep, "block string, data binary")
    return back.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(finish, f"row_id {kind.simpleString()}, base double, perturbed double")
