"""Named detectors, their runner and its guards (DET-11..15, DET-17, DET-18, UDF-01, UDF-08)."""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import PurePath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modules whose import registers detectors, and what a detector must never read.
ADAPTERS = ["calibrant.detectors.rules", "calibrant.detectors.judge"]
FORBIDDEN = ["set", "label", "agent", "repo", "matched"]

Score = Callable[[Column], Column]


@dataclass(frozen=True)
class Detector:
    """A score of a text column; higher means likelier written by a machine."""

    name: str
    version: str
    score: Score
    kind: str = "rule"
    note: str = ""


_factories: dict[str, tuple[str, str, Callable[[], Detector]]] = {}
_failed: dict[str, str] = {}


def register(name: str, kind: str, note: str = "") -> Callable:
    """Decorate a factory; it is called when the detector is first asked for."""

    def wrap(factory: Callable[[], Detector]) -> Callable[[], Detector]:
        _factories[name] = (kind, note, factory)
        return factory

    return wrap


def load_adapters(modules: list[str] | None = None) -> None:
    """Import adapters; one that fails becomes an unavailable entry."""
    for module in modules or ADAPTERS:
        try:
            importlib.import_module(module)
        except ImportError as error:
            _failed[module.rpartition(".")[2]] = str(error)


def available() -> dict[str, str]:
    """name -> note of the registered detectors, and why others are missing."""
    return {n: f"{kind}: {note}" for n, (kind, note, _) in sorted(_factories.items())} | {n: f"unavailable: {e}" for n, e in _failed.items()}


def get(name: str) -> Detector:
    if name not in _factories:
        raise KeyError(f"no detector {name!r}; there are {', '.join(sorted(_factories)) or 'none'}")
    return _factories[name][2]()


def score_texts(corpus: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """(row_id, source_id, detector, version, score); the detector's plan sees the text alone (DET-12, DET-13)."""
    seen = corpus.select(F.col("row_id"), F.col("source_id").cast("string").alias("source_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if found := set(seen.columns) & set(FORBIDDEN):
        raise ValueError(f"a detector must not read {sorted(found)}")
    return seen.select("row_id", "source_id", F.lit(detector.name).alias("detector"), F.lit(detector.version).alias("version"), detector.score(F.col("text")).cast("double").alias("score"))


def sweep(corpus: DataFrame, names: list[str], write: Callable[[DataFrame], None]) -> list[dict]:
    """Score with each detector and write its rows; a failing one is recorded and the others go on."""
    report = []
    for name in names:
        began = time.monotonic()
        try:
            write(score_texts(corpus, get(name)))
            report.append({"detector": name, "seconds": time.monotonic() - began, "error": None})
        except Exception as error:  # noqa: BLE001 - one detector must not end the sweep
            report.append({"detector": name, "seconds": time.monotonic() - began, "error": str(error)[:200]})
    return report


def relative(path: str, root: str) -> str:
    """A path inside ``root`` relative to it, others as they are (DET-18)."""
    p, r = PurePath(path), PurePath(root)
    return str(p.relative_to(r)) if p.is_relative_to(r) else path
