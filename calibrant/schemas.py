"""Column orders and domains of the corpus, and the labels for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Columns, sets and genres of the corpus, in report order.
CORPUS_COLUMNS = ["source_id", "set", "genre", "agent", "repo", "text", "n_chars", "label", "ext"]
SETS = {"P": "agent", "N1": "pre-cutoff human", "N2": "contemporary human", "N3": "pre-cutoff automation"}
GENRES = {"commit_message": "Commit message", "pr_body": "PR body", "issue_body": "Issue body", "comment": "Comment", "diff": "Diff"}

SCORES = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("detector", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def dimension(spark: SparkSession, labels: dict[str, str], key: str) -> DataFrame:
    """A label table with the report position of each key (a dozen rows)."""
    rows = [(i, k, v) for i, (k, v) in enumerate(labels.items())]
    return spark.createDataFrame(rows, f"position int, {key} string, {key}_label string")
