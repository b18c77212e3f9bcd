"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are those of its own text and of its
neighbours' lines, and how it repeats within the document; a transition score
joins it to the next line. The field is fitted here on a bounded sample of
labelled documents, whose lines all carry the document's label. A document's
score is the mean of its lines' forward-backward marginals, weighted by length
and calibrated. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.llm import _labels
from calibrant.llm._arrow import field, map_text
from calibrant.llm.quality_rules import calibrate

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
SYMBOLS = b"#*$%&|<>"
STOPS = b".,;:!?"
#: Edges that cut each measure into steps; a step is a feature of its own.
EDGES = (
    (1, 20, 60, 150, 400, 1000, 3000),  # bytes
    (1, 3, 8, 20, 60, 200),  # words
    (0.02, 0.08, 0.2, 0.5, 0.8),  # capitals among ASCII letters
    (0.005, 0.02, 0.05, 0.1, 0.2),  # symbols among bytes
    (0.01, 0.03, 0.08, 0.2),  # stops among bytes
    (0.01, 0.05, 0.2, 0.5),  # digits among bytes
    (0.01, 0.05, 0.2, 0.4),  # words that are a symbol alone
    (0.3, 0.5, 0.7, 0.85, 0.97),  # distinct words
    (0.01, 0.05, 0.2, 0.5),  # words equal to the one before
    (2.5, 4, 6, 9, 14),  # mean bytes of a word
    (0.5,),  # equal to an earlier line
    (0.5,),  # equal to the line before
    (0.01, 0.05, 0.2, 0.5),  # exclamation marks for each word
)
STEPS = sum(len(e) for e in EDGES)
#: The line's own steps, the previous and the next line's, and a constant.
FEATURES = 3 * STEPS + 1


def measures(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A row of measures for each line, and each line's weight (its bytes, at least one)."""
    rows, seen, before = [], set(), None
    for line in text.split(b"\n"):
        n, words = len(line), line.split()
        k = len(words) or 1
        size = n or 1
        capitals = n - len(line.translate(None, UPPER))
        letters = capitals + n - len(line.translate(None, LOWER))
        alone = sum(1 for w in words if len(w) == 1 and w in b"|#*$%&<>") if words else 0
        rows.append(
            (
                n,
                len(words),
                capitals / (letters or 1),
                (n - len(line.translate(None, SYMBOLS))) / size,
                (n - len(line.translate(None, STOPS))) / size,
                (n - len(line.translate(None, DIGITS))) / size,
                alone / k,
                len(set(words)) / k if words else 1.0,
                sum(map(bytes.__eq__, words, words[1:])) / k,
                (n - len(words)) / k,
                float(bool(words) and line in seen),
                float(bool(words) and line == before),
                line.count(b"!") / k,
            )
        )
        if words:
            seen.add(line)
        before = line
    table = np.array(rows, np.float64)
    return table, np.maximum(table[:, 0], 1.0)


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """A row of 0/1 features for each line, and the lines' weights (null: one empty line)."""
    table, weights = measures(text or b"")
    own = np.concatenate([(table[:, [i]] >= np.array(e)[None, :]) for i, e in enumerate(EDGES)], axis=1).astype(np.float32)
    none = np.zeros((1, own.shape[1]), np.float32)
    return np.concatenate([own, np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none]), np.ones((len(own), 1), np.float32)], axis=1), weights


@dataclass
class Field:
    """Emission weights of "good" over "bad", transition scores [from, to], and the calibration."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def marginals(self, emissions: np.ndarray) -> np.ndarray:
        """P(good) of each line by forward-backward."""
        scores = np.stack([np.zeros(len(emissions)), emissions], 1)
        p, _, _ = forward_backward(scores[None], np.array([len(emissions)]), self.moves)
        return p[0, :, 1]

    def raw(self, text: bytes | None) -> float:
        table, size = features(text)
        return float((self.marginals(table @ self.weights) * size).sum() / size.sum())

    def score(self, text: bytes | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * _logit(self.raw(text)) + self.offset, -30, 30))))


def _logit(p: float | np.ndarray) -> float | np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals [document, line, state], expected moves [from, to] in all, and log partition sums.

    Documents are padded to one length; each line's vector is scaled to sum to one.
    """
    n, steps, _ = scores.shape
    top = scores.max(2, keepdims=True)
    emit, step = np.exp(scores - top), np.exp(moves)
    alive = np.arange(steps)[None] < lengths[:, None]
    forward, scale = np.empty_like(emit), np.ones((n, steps))
    for t in range(steps):
        f = emit[:, t] if t == 0 else emit[:, t] * (forward[:, t - 1] @ step)
        s = f.sum(1)
        scale[:, t] = np.where(alive[:, t], s, 1)
        forward[:, t] = f / s[:, None]
    backward = np.ones_like(emit)
    for t in range(steps - 2, -1, -1):
        b = (emit[:, t + 1] * backward[:, t + 1]) @ step.T / scale[:, t + 1, None]
        backward[:, t] = np.where(alive[:, t + 1, None], b, 1)
    p = forward * backward
    p /= p.sum(2, keepdims=True)
    expected = np.zeros((2, 2))
    if steps > 1:
        pair = (forward[:, :-1, :, None] * step[None, None]) * (emit[:, 1:, None, :] * backward[:, 1:, None, :])
        pair /= pair.sum((2, 3), keepdims=True)
        expected = (pair * alive[:, 1:, None, None]).sum((0, 1))
    logz = (np.log(scale) * alive).sum(1) + (top[:, :, 0] * alive).sum(1)
    return p, expected, logz


def fit(rows: list[tuple[int, bytes]], counts: dict[int, int], rounds: int = 120, decay: float = 2e-3) -> Field | None:
    """Maximise the penalised likelihood of (label, text) rows; None unless both labels occur."""
    if len({label for label, _ in rows}) < 2:
        return None
    rows = sorted(rows, key=lambda r: (len(r[1]) * 2654435761 % 4294967296, r))
    cut = len(rows) * 3 // 4 if len(rows) >= 40 else len(rows)
    if len({label for label, _ in rows[:cut]}) < 2:
        cut = len(rows)
    tables = [features(t) for _, t in rows]
    y = np.array([label for label, _ in rows])
    each = {c: 1 / max(1, (y[:cut] == c).sum()) for c in (0, 1)}
    # documents of like length share a block, so that padding stays small
    order = sorted(range(cut), key=lambda i: len(tables[i][0]))
    blocks = []
    at = 0
    while at < len(order):
        k = at + 1
        while k < len(order) and (k - at + 1) * len(tables[order[k]][0]) <= 20_000 and len(tables[order[k]][0]) <= 2 * len(tables[order[at]][0]) + 8:
            k += 1
        own = order[at:k]
        lengths = np.array([len(tables[i][0]) for i in own])
        blocks.append((own, lengths, np.concatenate([tables[i][0] for i in own])))
        at = k
    w, moves = np.zeros(FEATURES), np.zeros((2, 2))
    size = FEATURES + 4
    m, v = np.zeros(size), np.zeros(size)
    for k in range(1, rounds + 1):
        g, gm = decay * w, decay * moves
        for own, lengths, table in blocks:
            flat = table @ w
            places = np.arange(lengths.max())[None] < lengths[:, None]
            scores = np.zeros((len(own), lengths.max(), 2))
            scores[places, 1] = flat
            share = np.array([each[int(y[i])] / n for i, n in zip(own, lengths, strict=True)])
            p, _, _ = forward_backward(scores, lengths, moves)
            miss = (p[:, :, 1] - y[own][:, None]) * share[:, None]
            g = g + table.T @ miss[places]
            # expected moves, weighted as the documents are
            gm = gm + _moves(scores, lengths, moves, y[own], share)
        grad = np.concatenate([g, gm.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.1 * np.sqrt(1 - 0.999**k) / (1 - 0.9**k) * m / (np.sqrt(v) + 1e-8)
        w, moves = w - step[:FEATURES], moves - step[FEATURES:].reshape(2, 2)
    model = Field(w, moves)
    held = range(cut, len(rows)) if cut < len(rows) else range(len(rows))
    raw = np.array([_logit(float((model.marginals(tables[i][0] @ w) * tables[i][1]).sum() / tables[i][1].sum())) for i in held])
    truth = y[list(held)]
    weight = np.array([counts.get(int(c), 1) / max(1, (truth == c).sum()) for c in truth], np.float64)
    model.slope, model.offset = calibrate(raw, truth, weight / weight.mean())
    return model


def _moves(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Gradient of the loss by the transition scores."""
    out = np.zeros((2, 2))
    for c in (0, 1):
        own = y == c
        if own.any():
            # a document's weight depends on its length and label; lengths in a block are alike
            for n in np.unique(lengths[own]):
                part = own & (lengths == n)
                if n > 1:
                    _, expected, _ = forward_backward(scores[part, :n], lengths[part], moves)
                    expected[c, c] -= (n - 1) * part.sum()
                    out += expected * share[part][0]
    return out


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, label: str = "quality", doc: str = "doc_id", text: str = "text", **bounds: int) -> Field | None:
    """Fit on a bounded sample (``_labels.sample``) of the labelled documents that ``where`` allows."""
    rows, counts = _labels.sample(docs, labels, label, doc, text, where, **bounds)
    return fit(sorted((r["label"], r["text"].encode()) for r in rows.toLocalIterator()), counts)


def score(df: DataFrame, model: Field | None, text: str = "text", drop_text: bool = False) -> DataFrame:
    """Append score (probability of good) and predicted (1 from 0.5 on).

    Null counts as empty, an empty text as one empty line; without a model every
    score is 0.5. Rows and other columns pass through.
    """

    def kernel(texts: list) -> list:
        p = [0.5 if model is None else model.score(t) for t in texts]
        return [p, [int(x >= 0.5) for x in p]]

    return map_text(df, text, kernel, [field("score", "double"), field("predicted", "int")], drop=(text,) if drop_text else ())


def label_lines(df: DataFrame, model: Field, text: str = "text") -> DataFrame:
    """Append line_quality, array<double>: the probability of good for each line."""

    def one(t: bytes | None) -> list[float]:
        return model.marginals(features(t)[0] @ model.weights).tolist()

    kernel: Callable[[list], list] = lambda texts: [[one(t) for t in texts]]
    return map_text(df, text, kernel, [field("line_quality", "array<double>")])


def held_out(doc: str = "doc_id") -> Column:
    """Rows that never teach: crc32 of the id as text has remainder 1 modulo 3 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 3 == 1, F.lit(False))
