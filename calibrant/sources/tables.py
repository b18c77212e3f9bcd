"""Parquet and JSON-lines readers of the engine (SRC-01..06, SRC-14, SRC-18..22)."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, cut to ``columns`` (SRC-01); an absent table or column is an error."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all cores, if its files have fewer splits than there are cores; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table cut to ``schema``, or an empty one where there is no such path (SRC-04)."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return found.select(*[F.col(f.name) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """All score files below a folder, NaN as null (SRC-02, SRC-03)."""
    found = spark.read.parquet(folder)
    return found.withColumn("score", nan_to_null(F.col("score").cast("double")))


def nan_to_null(score):
    return F.when(~F.isnan(score), score)


PROGRESS = T.StructType([T.StructField("repo", T.StringType()), T.StructField("rows", T.ArrayType(T.MapType(T.StringType(), T.StringType()))), T.StructField("errors", T.ArrayType(T.StringType()))])


def progress(lines: DataFrame, column: str = "value") -> DataFrame:
    """Progress records (repo, rows, errors) of JSON lines; broken lines and those without a repo go (SRC-05)."""
    parsed = lines.select(F.from_json(F.col(column), PROGRESS).alias("r")).select("r.*")
    return parsed.where(F.col("repo").isNotNull())


def progress_rows(records: DataFrame) -> DataFrame:
    """One row per collected item (SRC-06)."""
    return records.select("repo", F.explode("rows").alias("row"))


def progress_errors(records: DataFrame) -> DataFrame:
    return records.select("repo", F.explode("errors").alias("error"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and length of each file (SRC-14)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def env_settings(text: str, environment: dict[str, str]) -> dict[str, str]:
    """KEY=VALUE lines without comments and quotes; what the environment has wins (SRC-16)."""
    found = {}
    for line in text.splitlines():
        key, mark, value = line.strip().partition("=")
        if mark and key.strip() and not key.lstrip().startswith("#"):
            found[key.strip().removeprefix("export ").strip()] = value.strip().strip("\"'")
    return found | {k: environment[k] for k in found if k in environment}


def known_tables(spark: SparkSession, folder: str, wanted: list[str], known: list[str]) -> dict[str, int]:
    """Row counts of the wanted tables; names outside the catalogue are an error before anything is read (SRC-13, SET-04)."""
    if unknown := sorted(set(wanted) - set(known)):
        raise ValueError(f"unknown tables: {', '.join(unknown)}; there are {', '.join(sorted(known))}")
    return {name: table(spark, folder, name).count() for name in wanted}


def token(environment: dict[str, str], names: list[str], file: Path | None = None) -> str | None:
    """The first of the named settings that is set, else the file's first line (SRC-17)."""
    for name in names:
        if environment.get(name):
            return environment[name].strip()
    if file and file.exists():
        return (file.read_text(encoding="utf-8").splitlines() or [""])[0].strip() or None
    return None


def answer(spark: SparkSession, path: str) -> DataFrame:
    """A stored JSON answer of an endpoint as one row (SRC-15)."""
    return spark.read.option("multiLine", "true").json(path)


def triples(lines: DataFrame, column: str = "value") -> DataFrame:
    """(s, p, o, o_type) of N-Triples lines (SRC-18)."""
    pattern = r'^<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>)?)\s*\.\s*$'
    part = [F.regexp_extract(column, pattern, i) for i in range(1, 6)]
    iri = F.col(column).rlike(r"^<[^>]*>\s+<[^>]*>\s+<")
    kind = F.when(iri, "iri").when(part[4] == "", "string").otherwise(F.element_at(F.split(part[4], "#"), -1))
    return lines.where(F.col(column).rlike(pattern)).select(part[0].alias("s"), part[1].alias("p"), F.when(iri, part[2]).otherwise(part[3]).alias("o"), kind.alias("o_type"))


def query_files(folder: str) -> dict[str, tuple[str, str]]:
    """name -> (description from leading comments, text) of the ``*.sql`` files of a folder (SRC-19)."""
    found = {}
    for file in sorted(Path(folder).glob("*.sql")):
        lines = file.read_text(encoding="utf-8").splitlines()
        k = next((i for i, x in enumerate(lines) if not x.startswith("--")), len(lines))
        found[file.stem] = (" ".join(x.lstrip("- ") for x in lines[:k]), "\n".join(lines[k:]))
    return found


def snapshot_coverage(projects: DataFrame, responses: DataFrame) -> DataFrame:
    """Projects asked for, answered, and min / upper median / max of their snapshot counts (SRC-20)."""
    joined = projects.join(responses, "project", "left")
    counts = F.sort_array(F.collect_list("snapshots"))  # a probe asks for a few dozen projects
    return joined.agg(F.count("*").alias("asked"), F.count("snapshots").alias("answered"), F.min("snapshots").alias("least"), F.element_at(counts, (F.floor(F.size(counts) / 2) + 1).cast("int")).alias("middle"), F.max("snapshots").alias("most"))


def text_availability(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Sorted top-level keys and number of prose fields of JSON payloads (SRC-21, JSN-03)."""
    from calibrant.functions.structure import prose_fields

    keys = F.array_sort(F.json_object_keys(column))
    return payloads.select("project", keys.alias("keys"), F.size(prose_fields(F.col(column))).alias("prose"))


def manuscript(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, line) of the files that a glob matches, in order of name and line (SRC-22)."""
    whole = spark.read.option("wholetext", "true").text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("number", "line")).withColumn("number", F.col("number") + 1)
