"""Arrow plumbing shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from calibrant.shipping import ship

#: Rows per Arrow batch; long documents make larger batches needlessly heavy.
BATCH_ROWS = 512
#: Bytes of text that one call of a kernel sees at most (one text may be longer).
BLOCK_BYTES = 4 << 20

Kernel = Callable[..., list]


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for texts of any length, and see that workers have the kernels."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def blocks(sizes: list[int], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes add up to about ``most`` at most."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them in any case."""
    taken = {c.lower() for c in df.columns}
    return [n + "_" * next(k for k in range(len(taken) + 1) if (n + "_" * k).lower() not in taken) for n in names]


def map_text(df: DataFrame, column: str, kernel: Kernel, fields: list[T.StructField], drop: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """Append ``fields``, which ``kernel`` computes from the UTF-8 bytes of ``column``.

    The kernel gets a list of ``bytes`` or None, then a list of values for each
    column in ``also``, and returns one list per field.
    All other columns pass through untouched, but for those in ``drop``; one with
    the name of a new field is replaced. No shuffle; a text is never cut.
    """
    small_batches(df.sparkSession)
    names = {f.name for f in fields} | set(drop)
    kept = [f for f in df.schema.fields if f.name not in names]
    need = list(dict.fromkeys([*(f.name for f in kept), column, *also]))
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [to_arrow_schema(T.StructType([f])).field(0).type for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
            # only a block's texts are Python objects at a time
            for a, b in blocks(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                part = batch.slice(a, b - a)
                made = kernel(texts.slice(a, b - a).to_pylist(), *(part.column(part.schema.get_field_index(n)).to_pylist() for n in also))
                columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                columns += [pa.array(v, type=k) for v, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + [f.name for f in fields])

    return df.select(*[f"`{n}`" for n in need]).mapInArrow(run, T.StructType(kept + fields))


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if "<" in kind else {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}[kind])
