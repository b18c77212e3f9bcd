"""Quality rules: fixed text statistics, then a calibrated n-gram classifier.

The classifier is a logistic regression over hashed word and character n-grams,
trained here on a bounded sample of labelled rows and calibrated on the part of
the sample that it did not see. Its weights travel with the task (about 1 MB)
and every text is scored in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.llm import _bytes, _labels
from calibrant.llm._arrow import field, map_text

#: Fixed values of the rules.
MIN_WORDS, MAX_REPEATED_PERCENT, REPEAT_WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
#: Buckets of hashed n-grams, and the probability of good quality from which a text is kept.
BUCKET_BITS, THRESHOLD = 17, 0.5
BUCKETS = 1 << BUCKET_BITS
#: Families: characters (3 bytes), words, pairs of words.
FAMILIES = 3
#: The pair of a word and itself, and a line met before, have buckets of their own.
SAME_PAIR = BUCKETS * FAMILIES
SIZE = BUCKETS * FAMILIES + 1

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_U = np.uint64


def statistics(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text (null: zeros)."""
    if not text:
        return 0, 0, 0, 0, 0
    data = np.frombuffer(text, np.uint8)
    begins, ends = _bytes.word_places(text)
    n = len(begins)
    chars = int(((data & 0xC0) != 0x80).sum() - _bytes.SPACE[data].sum())
    lines, seen, repeated = text.split(b"\n"), set(), 0
    for line in lines:
        if line in seen:
            repeated += 1
        elif line.strip():
            seen.add(line)
    return n, chars, int(_SYMBOL[data].sum()), repeated, _repeat_words(text, n)


def _repeat_words(text: bytes, n: int, size: int = REPEAT_WINDOW) -> int:
    """Words inside runs of ``size`` words that the text holds twice or more."""
    if n <= size:
        return 0
    hashes = _bytes.window_hashes(_bytes.word_hashes(text), size)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    # equal hashes only point at candidates; the words decide
    words, places = text.split(), np.flatnonzero(twice).tolist()
    found: dict[tuple, list[int]] = {}
    for p in places:
        found.setdefault(tuple(words[p : p + size]), []).append(p)
    covered = np.zeros(n + 1, np.int64)
    for own in found.values():
        if len(own) > 1:
            np.add.at(covered, own, 1)
            np.add.at(covered, np.array(own) + size, -1)
    return int((np.cumsum(covered)[:n] > 0).sum())


def ngrams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams, and each one's share of its family."""
    data = np.frombuffer(text, np.uint8)
    parts, shares = [], []

    def add(buckets: np.ndarray) -> None:
        if len(buckets):
            parts.append(buckets)
            shares.append(np.full(len(buckets), 1.0 / len(buckets), np.float32))

    if len(data) >= 3:
        wide = data.astype(np.uint32)
        code = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
        add(((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32))
    words = _bytes.word_hashes(text)
    if len(words):
        add((words >> _U(64 - BUCKET_BITS)).astype(np.int32) + BUCKETS)
    if len(words) > 1:
        pairs = _bytes.mix(words[:-1] * _U(31) + words[1:])
        add(np.where(words[:-1] == words[1:], SAME_PAIR, (pairs >> _U(64 - BUCKET_BITS)).astype(np.int32) + 2 * BUCKETS).astype(np.int32))
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    return np.concatenate(parts), np.concatenate(shares)


@dataclass
class Model:
    """Weights of the n-grams, an intercept, and the calibration of the raw score."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, text: bytes | None) -> float:
        buckets, shares = ngrams(text or b"")
        return float(np.dot(self.weights[buckets], shares)) + self.intercept

    def probability(self, text: bytes | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.raw(text) + self.offset, -30, 30))))


def _compact(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    buckets, shares = ngrams(text)
    own, at = np.unique(buckets, return_inverse=True)
    return own.astype(np.int32), np.bincount(at, weights=shares, minlength=len(own)).astype(np.float32)


def fit(rows: list[tuple[int, bytes]], counts: dict[int, int], rounds: int = 80, decay: float = 1e-5) -> Model | None:
    """Train on (label, text) rows; None unless both labels occur. Rows weigh as their class does among all labels."""
    kinds = [label for label, _ in rows]
    if len(set(kinds)) < 2:
        return None
    order = np.argsort(_bytes.mix(np.array([len(t) * 1009 + i for i, (_, t) in enumerate(rows)], np.uint64)))
    cut = len(rows) * 3 // 4 if len(rows) >= 40 else len(rows)
    vectors = [_compact(rows[i][1]) for i in order]
    y = np.array([rows[i][0] for i in order], np.float64)
    share = {c: counts.get(c, 0) / max(1, (y == c).sum()) for c in (0, 1)}
    weight = np.array([share[int(c)] for c in y])
    weight /= weight.mean()
    train = vectors[:cut]
    if len(set(y[:cut])) < 2:
        cut, train = len(rows), vectors
    features = np.concatenate([v[0] for v in train])
    values = np.concatenate([v[1] for v in train]).astype(np.float64)
    sizes = np.array([len(v[0]) for v in train])
    row = np.repeat(np.arange(cut), sizes)
    w, b = np.zeros(SIZE), 0.0
    m, v, mb, vb = np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0
    # both classes weigh alike while the boundary is sought; calibration restores their shares
    even = np.where(y[:cut] == 1, 0.5 / max(1, (y[:cut] == 1).sum()), 0.5 / max(1, (y[:cut] == 0).sum()))
    for k in range(1, rounds + 1):
        z = np.bincount(row, weights=w[features] * values, minlength=cut) + b
        miss = even * (1 / (1 + np.exp(-z)) - y[:cut])
        g = np.bincount(features, weights=miss[row] * values, minlength=SIZE) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * miss.sum(), 0.999 * vb + 0.001 * miss.sum() ** 2
        fix = np.sqrt(1 - 0.999**k) / (1 - 0.9**k)
        w -= 0.5 * fix * m / (np.sqrt(v) + 1e-8)
        b -= 0.5 * fix * mb / (np.sqrt(vb) + 1e-8)
    model = Model(w.astype(np.float32), b)
    held = slice(cut, None) if cut < len(rows) else slice(0, None)
    raw = np.array([float(np.dot(model.weights[f], x)) + b for f, x in vectors[held]])
    model.slope, model.offset = calibrate(raw, y[held], weight[held])
    return model


def calibrate(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from raw score to probability, targets smoothed."""
    positive, negative = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    scale = max(1e-6, float(raw.std()))
    x = np.stack([raw / scale, np.ones(len(raw))], 1)
    p = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        g = x.T @ (weight * (q - target)) + 1e-3 * p
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        p -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(1e-6, p[0]) / scale, p[1]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc: str = "doc_id", text: str = "text", **bounds: int) -> Model | None:
    """Fit on a bounded sample (``_labels.sample``) of the labelled documents; None without both labels."""
    rows, counts = _labels.sample(docs, labels, label, doc, text, **bounds)
    data = sorted((r["label"], r["text"].encode()) for r in rows.toLocalIterator())
    return fit(data, counts)


FIELDS = [field(n, "long") for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [field("base_failed", "boolean"), field("quality", "double"), field("kept", "boolean")]


def judge(df: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Append the statistics, base_failed, quality (probability; null without a model) and kept.

    Null and empty texts have no words and fail. A text that passes the base rules
    is kept if its probability reaches ``threshold``, or if there is no model.
    Rows and other columns pass through; ties and repeats get equal verdicts.
    """

    def kernel(texts: list) -> list:
        rows = []
        for t in texts:
            found = statistics(t)
            failed = found[0] < MIN_WORDS or 100 * found[4] > MAX_REPEATED_PERCENT * found[0]
            p = None if model is None else model.probability(t)
            rows.append((*found, failed, p, not failed and (p is None or p >= threshold)))
        return [list(c) for c in zip(*rows, strict=True)]

    return map_text(df, text, kernel, FIELDS)


def keep_good(df: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Only the rows whose text is kept, with the columns that they had."""
    names = df.columns
    own = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{text}`").alias("_judged"))
    kept = judge(own, model, "_judged", threshold).where("kept")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
