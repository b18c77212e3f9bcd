"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has a bit set if over half of the text's shingle hashes have it.
Candidates share a key. Keys come either from
blocks (exact: whatever differs in few bits leaves enough blocks equal, so
no link is lost) or, for wide radii, from bands of least shingle hashes (with a
stated chance of a miss; an exact check of the similarity follows). Distinct
fingerprints or shingle sets, not documents, are compared.

Fingerprints of a key stand in bit planes: word j of plane b holds bit b of 64
neighbours. Row i is compared with row i + d for all i at once: the planes are
XORed with themselves shifted by d rows, carry-save counters add the planes up,
and 64-row blocks in which every distance exceeds the radius are abandoned.
Matches are reduced to a spanning forest on the spot, so that a dense group
yields as many links as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.llm._arrow import field, map_text, small_batches
from calibrant.llm._state import keep
from calibrant.llm.components import components

#: Rows of one key that are compared in one task; a larger group is dealt out by pairs of its parts.
PART = 4096
#: Large keys up to which their table is broadcast.
BROADCAST_KEYS = 100_000
#: Nodes of large groups up to which their list (six numbers each) is broadcast to pick their texts.
BROADCAST_NODES = 200_000
SEED = 42
_U = np.uint64
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of lower-cased words (fewer: all of them; none: nothing)."""
    own = (text or b"").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    if len(own) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(own), seed)], np.uint64)
    h = xxhash.xxh64_intdigest
    if words == 3:
        return np.fromiter((h(b"%b %b %b" % t, seed) for t in zip(own, own[1:], own[2:], strict=False)), np.uint64, len(own) - 2)
    return np.fromiter((h(b" ".join(own[i : i + words]), seed) for i in range(len(own) - words + 1)), np.uint64, len(own) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is set if over half of the hashes have it; none give zero."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for a in range(0, n, 65_536):
        bits = np.unpackbits(hashes[a : a + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", words: int = 3, lanes: int = 1, name: str = "fp", drop_text: bool = True) -> DataFrame:
    """Append columns fp0.. (long), 64 bits of the fingerprint each; ``lanes`` of them, the later ones from remixed hashes."""

    def kernel(texts: list) -> list:
        from calibrant.llm._bytes import mix

        out: list[list[int]] = [[] for _ in range(lanes)]
        for t in texts:
            hashes = shingle_hashes(t, words)
            for k in range(lanes):
                value = fingerprint(hashes if k == 0 else mix(hashes + _U(k)))
                out[k].append(value - (1 << 64) if value >> 63 else value)
        return out

    return map_text(df, text, kernel, [field(f"{name}{k}", "long") for k in range(lanes)], drop=(text,) if drop_text else ())


def block_masks(radius: int, spare: int = 2) -> list[int]:
    """64-bit masks: each leaves out ``radius`` of ``radius + spare`` blocks, so one of them sees no difference."""
    n = radius + spare
    cuts = [64 * i // n for i in range(n + 1)]
    block = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(n)]
    return [sum(block[i] for i in kept) for kept in combinations(range(n), spare)]


def bit_planes(lanes: list[np.ndarray]) -> np.ndarray:
    """planes[b, j]: bit b of rows 64 j to 64 j + 63 (rows beyond the last are zero)."""
    n = len(lanes[0])
    width = -(-n // 64)
    out = []
    for values in lanes:
        padded = np.zeros(width * 64, np.uint64)
        padded[:n] = values
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out.append(np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64))
    return np.concatenate(out)


def shifted(planes: np.ndarray, d: int) -> np.ndarray:
    """Planes with row i + d (d under 64) in the place of row i."""
    if not d:
        return planes
    out = planes >> _U(d)
    out[..., :-1] |= planes[..., 1:] << _U(64 - d)
    return out


class Comparison:
    """Distances of all rows i to rows i + d, for up to 64 values of d at once."""

    def __init__(self, planes: np.ndarray, most: int):
        self.planes = planes
        self.moved = np.stack([shifted(planes, r) for r in range(min(64, most))])

    def near(self, alive: np.ndarray, q: int, radius: int) -> np.ndarray:
        """alive[r, j]: bits of the rows to compare with those 64 q + r further on; of these, the near ones.

        Counters hold distances vertically, a bit plane per power of two; two
        planes at a time go through a carry-save adder, overflow sticks. Blocks
        of 64 rows leave the comparison once all their rows are over the radius.
        """
        steps, width = alive.shape
        digits = max(1, (radius + 1).bit_length())
        inner = width - q
        flat = alive[:, :inner].ravel()
        where = np.flatnonzero(flat)
        out = np.zeros(steps * inner, np.uint64)
        if not len(where):
            return np.zeros_like(alive)
        dense = 2 * len(where) > len(flat)
        if dense:
            where = np.arange(len(flat))
        row, column = np.divmod(where, inner)
        counters = np.zeros((digits, len(where)), np.uint64)
        over = ~flat[where]

        def differing(b: int) -> np.ndarray:
            if dense:
                return (self.planes[b, None, :inner] ^ self.moved[:steps, b, q:]).ravel()
            return self.planes[b, column] ^ self.moved[row, b, column + q]

        for b in range(0, len(self.planes), 2):
            x, y = differing(b), differing(b + 1)
            half = x ^ y
            carry = (x & y) | (counters[0] & half)
            counters[0] ^= half
            for k in range(1, digits):
                up = counters[k] & carry
                counters[k] ^= carry
                carry = up
            over |= carry
            if b % 8 == 6:
                over |= _above(counters, radius)
                still = over != _ALL
                n = int(still.sum())
                if not n:
                    return np.zeros_like(alive)
                if n < 0.6 * len(where):
                    where, row, column, over = where[still], row[still], column[still], over[still]
                    counters, dense = np.ascontiguousarray(counters[:, still]), False
        over |= _above(counters, radius)
        out[where] = ~over
        result = np.zeros_like(alive)
        result[:, :inner] = out.reshape(steps, inner)
        return result


def _above(counters: np.ndarray, radius: int) -> np.ndarray:
    """Rows whose count is over the radius."""
    above = np.zeros_like(counters[0])
    equal = np.full_like(counters[0], _ALL)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def forest(n: int, u: np.ndarray, v: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """Lowest member of each of n nodes' groups under the links u-v (and those already in ``parent``)."""
    p = np.arange(n) if parent is None else parent
    while len(u):
        a, b = p[u], p[v]
        m = a != b
        if not m.any():
            break
        u, v, a, b = u[m], v[m], a[m], b[m]
        np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
        while True:
            q = p[p]
            if np.array_equal(q, p):
                break
            p = q
    return p


def linked(group: np.ndarray, lanes: list[np.ndarray], radius: int, side: np.ndarray | None = None) -> np.ndarray:
    """For rows sorted by group: the lowest row that each reaches by links inside its group.

    With ``side``, rows of one part (side 0 or 1) of a large group are compared
    with the other part only; a group's rows are then sorted by side.
    """
    n = len(group)
    parent = np.arange(n)
    if n < 2:
        return parent
    planes = bit_planes(lanes)
    index = np.arange(n)
    ends = np.searchsorted(group, group, side="right")
    longest = int((ends - index).max())
    if longest < 2:
        return parent
    width = planes.shape[1]
    comparison = Comparison(planes, longest)
    steps = np.arange(len(comparison.moved))
    u: list[np.ndarray] = []
    v: list[np.ndarray] = []
    waiting = 0
    for q in range(-(-longest // 64)):
        d = 64 * q + steps
        rows = np.zeros((len(d), width * 64), bool)
        rows[:, :n] = (index + d[:, None] < ends) & (d[:, None] > 0)
        if side is not None:
            rows[:, :n] &= side[np.minimum(index + d[:, None], n - 1)] != side
        if not rows.any():
            continue
        hit = comparison.near(np.packbits(rows, axis=1, bitorder="little").view(np.uint64), q, radius)
        if hit.any():
            step, found = np.divmod(np.flatnonzero(np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little")), width * 64)
            u.append(found)
            v.append(found + d[step])
            waiting += len(found)
            if waiting > 1_000_000:
                parent = forest(n, np.concatenate(u), np.concatenate(v), parent)
                u, v, waiting = [], [], 0
    if u:
        parent = forest(n, np.concatenate(u), np.concatenate(v), parent)
    return parent


def dealt(keyed: DataFrame, part: int) -> DataFrame:
    """``keyed`` (key, node, ..) with ``pair`` and ``side``: rows of a key with more than ``part`` rows once for each pair of its parts.

    With a column ``settled``, such rows of a key are known to belong together: their
    parts are paired with those of the key's other rows only, and a large key without others goes.
    """
    known = F.col("settled") if "settled" in keyed.columns else F.lit(False)
    sizes = keyed.groupBy("key").agg(F.count_if(~known).alias("n"), F.count_if(known).alias("m")).where(F.col("n") + F.col("m") > part)
    # at most rows / part keys are large
    large = keep(sizes.select("key", F.ceil(F.col("n") / part).alias("open"), F.ceil(F.col("m") / part).alias("shut")))
    n_large = large.count()
    if not n_large:
        return keyed.select("*", F.lit(0).cast("long").alias("pair"), F.lit(None).cast("int").alias("side"))
    placed = keyed.join(F.broadcast(large) if n_large <= BROADCAST_KEYS else large, "key", "left").where("open IS NULL OR open > 0")
    placed = placed.select(*keyed.columns, F.coalesce("open", F.lit(1)).alias("open"), F.coalesce("shut", F.lit(0)).alias("shut"))
    spot = F.xxhash64("node")
    mine = F.when(known, F.col("open") + F.pmod(spot, F.greatest("shut", F.lit(1)))).otherwise(F.pmod(spot, F.col("open")))
    placed = placed.withColumn("mine", mine).withColumn("last", F.when(known, F.col("open")).otherwise(F.col("open") + F.col("shut")) - 1)
    copies = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other"))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") != F.col("other"), (F.col("mine") > F.col("other")).cast("int"))
    return copies.select(*keyed.columns, (low * (F.col("open") + F.col("shut")) + high).alias("pair"), side.alias("side"))


def links(prints: DataFrame, masks: list[list[int]] | None, radius: int, part: int = PART) -> DataFrame:
    """Links (a, b) between rows of ``prints`` (node, fp0..) that share a key and differ in ``radius`` bits at most.

    Not all such pairs, but a spanning forest of those in each key (and pair of
    parts of a key with more than ``part`` rows): the components are the same.
    Without ``masks``, keys are those in the column ``keys``.
    """
    small_batches(prints.sparkSession)
    lanes = [c for c in prints.columns if c.startswith("fp")]

    def key(mask: list[int], k: int) -> Column:
        signed = [m - (1 << 64) if m >> 63 else m for m in mask]
        return F.xxhash64(F.lit(k), *[F.col(c).bitwiseAND(F.lit(m).cast("long")) for c, m in zip(lanes, signed, strict=True)])

    keys = F.col("keys") if masks is None else F.array(*[key(m, k) for k, m in enumerate(masks)])
    keyed = prints.select("node", *lanes, F.explode(keys).alias("key"))
    everything = dealt(keyed, part)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            left = table if left is None else pa.concat_tables([left, table])
            if left.num_rows < 16_384:
                continue
            group = _groups(left)
            cut = int(np.searchsorted(group, group[-1]))  # the last key may go on
            if cut:
                yield found(left.slice(0, cut))
                left = left.slice(cut)
        if left is not None and left.num_rows:
            yield found(left)

    def found(table: pa.Table) -> pa.RecordBatch:
        group = _groups(table)
        side = table.column("side").to_numpy() if table.column("side").null_count < table.num_rows else None
        values = [table.column(c).to_numpy().view(np.uint64) for c in lanes]
        node = table.column("node").to_numpy()
        if side is None:
            lead = linked(group, values, radius)
        else:
            # rows of one part (no side) go on their own; the others part against part
            alone = np.isnan(side)
            lead = np.arange(table.num_rows)
            for chosen, sides in ((np.flatnonzero(alone), None), (np.flatnonzero(~alone), side)):
                if len(chosen):
                    own = linked(group[chosen], [v[chosen] for v in values], radius, None if sides is None else sides[chosen])
                    lead[chosen] = chosen[own]
        m = lead != np.arange(len(lead))
        return pa.RecordBatch.from_arrays([pa.array(node[m]), pa.array(node[lead[m]])], ["a", "b"])

    ordered = everything.repartition("key", "pair").sortWithinPartitions("key", "pair", "side")
    return ordered.mapInArrow(compare, "a long, b long")


def _groups(table: pa.Table) -> np.ndarray:
    """A rising number for each run of rows with one key and pair."""
    key, pair = table.column("key").to_numpy(), table.column("pair").to_numpy()
    return np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]))


def cluster(df: DataFrame, doc: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """doc, fingerprint (long) and component_id of every row: the lowest id reachable by links of ``radius`` bits at most.

    Exact: keys of ``block_masks`` lose no link. Null, empty and wordless texts
    have fingerprint zero and are linked like any other; texts of fewer words
    than a shingle are one shingle. Repeated rows stay; a null id stays null and
    never is the lowest while its component has another.
    """
    prints = keep(fingerprints(df.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text")), "text", words))
    distinct = keep(prints.groupBy(F.col("fp0").alias("node")).agg(F.min("doc").alias("low")))
    found = links(distinct.select("node", F.col("node").alias("fp0")), [[m] for m in block_masks(radius)], radius)
    roots = components(found)
    named = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = named.join(lowest, "root").select(F.col("node").alias("fp0"), "component_id")
    return prints.join(labels, "fp0").select(F.col("doc").alias(doc), F.col("fp0").alias("fingerprint"), "component_id")


#: The wide form: 64-bit lanes of the fingerprint, and keys: 24 bands of 5 least hashes each.
WIDE_LANES, BAND, BANDS = 4, 5, 24
#: Standard deviations of the distance that the radius lies above its mean. The exact check
#: follows, so it is wide enough for texts of few shingles, whose fingerprints differ in more bits.
MARGIN = 5.0
#: Texts of one candidate group that are compared in one task; a larger group is dealt out by pairs of its parts.
TEXTS = 512
_odd = np.random.RandomState(11)
_FACTORS = _odd.randint(0, 2**63, BAND * BANDS, dtype=np.uint64) * _U(2) + _U(1)


def wide_radius(similarity: float, lanes: int = WIDE_LANES) -> int:
    """Bits in which fingerprints of texts of that Jaccard similarity differ at most, but for one pair in a million."""
    p, n = np.arccos(2 * similarity / (1 + similarity)) / np.pi, 64 * lanes
    return int(n * p + MARGIN * np.sqrt(n * p * (1 - p)))


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Distinct shingle hashes in rising order."""
    return np.unique(shingle_hashes(text, words))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band of least hashes; two sets of similarity s share one with a chance of 1 - (1 - s ** BAND) ** BANDS."""
    from calibrant.llm._bytes import mix

    if not len(hashes):
        return np.zeros(BANDS, np.uint64)
    least = np.full(len(_FACTORS), _ALL)
    for a in range(0, len(hashes), 4096):
        least = np.minimum(least, mix(hashes[None, a : a + 4096] * _FACTORS[:, None]).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND).T:
        keys = mix(keys * _FACTORS[0] + column)
    return keys


def wide_prints(df: DataFrame, text: str, words: int) -> DataFrame:
    """Replace the text by node (a digest of its shingle set), fp0.. and the keys."""

    def kernel(texts: list) -> list:
        from calibrant.llm._bytes import mix

        node: list[int] = []
        prints: list[list[int]] = [[] for _ in range(WIDE_LANES)]
        keys: list[list[int]] = []
        for t in texts:
            own = shingle_set(t, words)
            digest = xxhash.xxh64_intdigest(own.tobytes(), SEED)
            node.append(digest - (1 << 64) if digest >> 63 else digest)
            for k in range(WIDE_LANES):
                value = fingerprint(own if k == 0 else mix(own + _U(k)))
                prints[k].append(value - (1 << 64) if value >> 63 else value)
            keys.append(band_keys(own).view(np.int64).tolist())
        return [node, *prints, keys]

    fields = [field("node", "long"), *[field(f"fp{k}", "long") for k in range(WIDE_LANES)], field("keys", "array<bigint>")]
    return map_text(df, text, kernel, fields, drop=(text,))


def similar(sets: list[np.ndarray], similarity: float, side: np.ndarray | None = None) -> np.ndarray:
    """For each set the lowest that it reaches by links of ``similarity`` or more; with ``side``, links across sides only."""
    n = len(sets)
    parent = np.arange(n)
    size = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(parent, size)
    _, shingle, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    m = shared[shingle]
    owner, column = owner[m], place[shingle[m]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float32)  # exact: counts stay far below 2 ** 24
    width = int(shared.sum())
    step = max(256, (4 << 20) // n)
    for a in range(0, width, step):
        i, j = np.searchsorted(column, [a, a + step])
        has = np.zeros((n, min(step, width - a)), np.float32)
        has[owner[i:j], column[i:j] - a] = 1
        common += has @ has.T
    either = size[:, None] + size - common
    near = common >= similarity * either - 1e-6
    if side is not None:
        near &= side[:, None] != side
    return forest(n, *np.nonzero(np.triu(near, 1)), parent)


def centers(chosen: DataFrame, part: int = TEXTS) -> DataFrame:
    """(key, center, parts) of each key of ``chosen`` (key, node, fp0) with more than ``part`` nodes.

    The center is the node nearest to the fingerprint of the key's majority, bit by
    bit: in a group of edited copies of one text that is the text, or a copy little
    changed. ``parts`` of about ``part`` nodes make up the key.
    """
    large = keep(chosen.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > part))
    n_large = large.count()
    own = chosen.join(F.broadcast(large) if n_large <= BROADCAST_KEYS else large, "key")
    bits = [F.sum(F.shiftright("fp0", b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(64)]
    counted = own.groupBy("key", "n").agg(*bits)
    majority = F.lit(0).cast("long")
    for b in range(64):
        majority = majority.bitwiseOR(F.when(2 * F.col(f"b{b}") > F.col("n"), F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long")).otherwise(0))
    middle = counted.select("key", majority.alias("middle"))
    placed = own.join(F.broadcast(middle) if n_large <= BROADCAST_KEYS else middle, "key")
    far = F.bit_count(F.col("fp0").bitwiseXOR(F.col("middle")))
    return keep(placed.groupBy("key", "n").agg(F.min_by("node", F.struct(far, "node")).alias("center")).select("key", "center", F.ceil(F.col("n") / part).alias("parts")))


def starred(members: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) between nodes of ``members`` (key, node, center, parts, text) of one part of a key, to which its center comes too.

    A node that the center reaches inside the part is linked to it. A key's texts are dealt
    out over its parts: no task gathers a large key, and work is in proportion to its texts.
    """
    lead = F.col("node") == F.col("center")
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    spots = F.when(lead, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(part))
    placed = members.select("key", F.explode(spots).alias("pair"), F.lit(None).cast("int").alias("side"), (~lead).alias("late"), "node", "text")
    return _compared(placed, words, similarity)


def verified(members: DataFrame, words: int, similarity: float, part: int = TEXTS) -> DataFrame:
    """Links (a, b) between nodes of one key of ``members`` (key, node, text) whose shingle sets have that Jaccard similarity.

    All pairs of a key are compared, but for those of ``settled`` nodes (if there is
    that column) of a key with more than ``part``; of the links, a spanning forest per task is handed on.
    """
    return _compared(dealt(members, part).withColumn("late", F.lit(False)), words, similarity)


def _compared(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """A spanning forest of the links in each key and pair of ``rows`` (key, pair, side, late, node, text); a tree's root is its first row, the late ones last."""
    small_batches(rows.sparkSession)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        nodes: list[int] = []
        sides: list[int | None] = []
        sets: list[np.ndarray] = []

        def found() -> pa.RecordBatch:
            side = None if sides[0] is None else np.array(sides)
            lead = similar(sets, similarity, side) if len(sets) > 1 else np.arange(len(sets))
            m = lead != np.arange(len(lead))
            node = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(node[m]), pa.array(node[lead[m]])], ["a", "b"])

        for batch in batches:
            key, pair, side, node = (batch.column(k).to_pylist() for k in range(4))
            texts = batch.column(4).cast(pa.binary())
            for i, group in enumerate(zip(key, pair, (s is None for s in side), strict=True)):
                if group != now:
                    if len(nodes) > 1:
                        yield found()
                    now, nodes, sides, sets = group, [], [], []
                if nodes and nodes[-1] == node[i]:
                    continue  # a repeated row
                nodes.append(node[i])
                sides.append(side[i])
                sets.append(shingle_set(texts[i].as_py(), words))
        if len(nodes) > 1:
            yield found()

    ordered = rows.select("key", "pair", "side", "node", "text", "late").repartition("key", "pair").sortWithinPartitions("key", "pair", "side", "late", "node")
    return ordered.mapInArrow(compare, "a long, b long")


def settle(chosen: DataFrame, texts: DataFrame, words: int, similarity: float, part: int = TEXTS) -> tuple[DataFrame, DataFrame]:
    """(links, ``chosen`` with ``settled``): the nodes of keys with more than ``part`` that their center reaches inside their part."""
    middle = centers(chosen, part)
    n_large = middle.count()
    middle = F.broadcast(middle) if n_large <= BROADCAST_KEYS else middle
    if not n_large:
        none = chosen.sparkSession.createDataFrame([], "a long, b long")
        return none, chosen.withColumn("settled", F.lit(False))
    picked = keep(chosen.join(middle, "key").select("k1", "k2", "key", "node", "center", "parts"))
    large = texts.join(F.broadcast(picked) if picked.count() <= BROADCAST_NODES else picked, ["k1", "k2"])
    found = keep(starred(large, words, similarity))
    heart = middle.select(F.col("center").alias("node"))
    near = found.join(heart.withColumnRenamed("node", "b"), "b", "left_semi").select(F.col("a").alias("node")).unionByName(heart).withColumn("settled", F.lit(True))
    return found, chosen.join(near, "node", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))


def unique(df: DataFrame, doc: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates by shingles of ``words``: that with the lowest id.

    Texts are linked if the Jaccard similarity of their shingle sets is
    ``similarity`` or more: every pair in a group of candidates is checked. A group
    of over ``TEXTS`` is first compared in parts to which its center comes too; what the
    center reaches there is one group whatever other links it has, so only the rest meets all others.
    Candidates share a key and have fingerprints within ``wide_radius``; at
    0.8 a lone pair fails to with a chance of 0.0001. Texts without words form one
    group; of rows with equal id (or null, which counts as highest) and text one
    stays. Columns stay as they are.
    """
    radius = wide_radius(similarity)
    names = df.columns
    value = F.col(f"`{text}`").cast("string")
    own = F.col(f"`{doc}`")
    # equal id and text make equal rows: k1, k2 tell rows apart
    marked = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], own.alias("doc"), value.alias("text"), F.xxhash64(own, value).alias("k1"), F.xxhash64(F.lit(1), own, value).alias("k2"))
    wide = keep(wide_prints(marked.select("doc", "k1", "k2", "text"), "text", words))
    prints = wide.select("doc", "k1", "k2", "node")
    lanes = [f"fp{k}" for k in range(WIDE_LANES)]
    distinct = keep(wide.groupBy("node").agg(F.min_by(F.struct(*lanes, "keys", "k1", "k2"), F.struct("k1", "k2")).alias("w")).select("node", "w.*"))
    candidates = components(links(distinct.select("node", *lanes, "keys"), None, radius))
    chosen = keep(distinct.select("node", "k1", "k2", "fp0").join(candidates.withColumnRenamed("root", "key"), "node"))
    texts = marked.select("k1", "k2", "text")
    found, left = settle(chosen, texts, words, similarity)
    members = texts.join(left, ["k1", "k2"]).select("key", "node", "settled", "text")
    roots = components(verified(members, words, similarity).unionByName(found))
    named = prints.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "k1", "k2")).alias("w")).select("w.k1", "w.k2")
    kept = marked.drop("doc", "text").join(keep(first), ["k1", "k2"], "left_semi")
    rows = kept.groupBy("k1", "k2").agg(*[F.first(f"c{i}").alias(f"c{i}") for i in range(len(names))])
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
