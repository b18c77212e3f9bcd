"""JSON, date, hash and array functions (DAT, MTH, ARR, JSN, HSH)."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def utc(stamp: Column) -> Column:
    """Instant of an ISO text with any offset; null where it is none (DAT-01)."""
    return F.try_to_timestamp(stamp)


def iso_seconds(at: Column) -> Column:
    """ISO text of an instant to the second; years outside 0 to 9999 as plain numbers, without the plus sign of ``date_format``."""
    year = F.year(at)
    shown = F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    return F.concat(shown, F.date_format(at, "-MM-dd'T'HH:mm:ss"))


def before_cutoff(cutoff: str, *stamps: Column) -> Column:
    """Every stamp is there and earlier (FLT-08, DAT-02, STM-03); a null one means false."""
    out = F.lit(True)
    for stamp in stamps:
        out = out & F.coalesce(stamp < F.lit(cutoff).cast("timestamp"), F.lit(False))
    return out


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """MTH-01; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def finite(x: Column) -> Column:
    """MTH-03, FLT-14; null is not finite."""
    return F.coalesce(~F.isnan(x) & ~F.abs(x).isin(float("inf")), F.lit(False))


def population_std(values: Column) -> Column:
    """MTH-04 over an array; zero for one value or none."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.greatest(n, F.lit(1))
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(n > 1, F.sqrt(squares / n)).otherwise(F.lit(0.0))


def edges(bins: int) -> list[float]:
    """Borders of equal bins of the unit interval, as binary fractions round them (MTH-05)."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def prose_fields(payload: Column) -> Column:
    """array<struct<path, n>>: strings over 300 characters of a JSON text, in the first three items of lists (JSN-02, UDTF-03).

    Recursion has no built-in form; payloads are few and pass in Arrow batches.
    """

    def walk(x, path: str, out: list) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                walk(v, f"{path}.{k}", out)
        elif isinstance(x, list):
            for i, v in enumerate(x[:3]):
                walk(v, f"{path}[{i}]", out)
        elif isinstance(x, str) and len(x) > 300:
            out.append((path, len(x)))

    def run(column: pd.Series) -> pd.Series:
        import json

        def one(text: str | None) -> list:
            out: list = []
            try:
                walk(json.loads(text or ""), "", out)
            except ValueError:
                return []
            return [{"path": p, "n": n} for p, n in out]

        return column.map(one)

    return F.pandas_udf(run, "array<struct<path:string,n:int>>")(payload)


def text_digest(x: Column) -> Column:
    """The first eight bytes of BLAKE2b as hex (HSH-02)."""

    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: hashlib.blake2b((t or "").encode("utf-8", "replace"), digest_size=8).hexdigest())

    return F.pandas_udf(run, "string")(x)


def node_id(x: Column) -> Column:
    """A stable identifier of a source id (HSH-03)."""
    return F.md5(x.cast("string"))


def hash_order(seed: int | str, *keys: Column) -> Column:
    """A repeatable shuffle: order by this (SMP-05, SMP-07)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
