"""Fixture tables in the shape of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.sources.tables import table

#: Detectors of the line view, by the measure that each reads.
LINE_DETECTORS = ["price", "qty", "discount", "tax", "flag", "probability"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels' set: toxic N3, poor P, good N1, unlabelled N2."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    kind = F.when(F.col("toxic") == 1, "N3").when(F.col("quality") == 0, "P").when(F.col("quality") == 1, "N1").otherwise("N2")
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(F.col("doc_id").alias("row_id"), F.col("doc_id").cast("string").alias("source_id"), "text", "n_chars", F.col("lang").alias("genre"), F.col("source").alias("agent"), F.col("source").alias("repo"), F.lit(None).cast("string").alias("ext"), kind.alias("set"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns: assistant P, user N1, system N3; a version and a length score."""
    turns = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "assistant", "P").when(F.col("role") == "user", "N1").otherwise("N3")
    ident = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    n = F.length("text")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), ident.alias("source_id"), "text", n.alias("n_chars"), F.lit("comment").alias("genre"), F.col("role").alias("agent"), F.col("conv_id").cast("string").alias("repo"), F.lit(None).cast("string").alias("ext"), kind.alias("set"), F.floor(n / 50).cast("double").alias("score"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as texts with six scores each, one row per line and detector."""
    items = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus"])
    kind = F.when(F.col("l_returnflag") == "R", "P").when(F.col("l_returnflag") == "N", "N1").otherwise("N3")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey)
    measure = F.create_map(
        F.lit("price"), F.col("l_extendedprice"), F.lit("qty"), F.col("l_quantity"), F.lit("discount"), F.col("l_discount"), F.lit("tax"), F.col("l_tax"),
        F.lit("flag"), (F.col("l_tax") > 0.05).cast("double"), F.lit("probability"), F.col("l_quantity") / 50.0,
    )
    wide = joined.select(F.col("o_orderpriority").alias("genre"), F.col("o_orderstatus").alias("agent"), F.col("l_linestatus").alias("ext"), kind.alias("set"), (F.col("l_linenumber") % 2 == 0).alias("matched"), F.floor("l_extendedprice").cast("long").alias("n_chars"), F.explode(measure).alias("detector", "score"))
    return wide


#: The same views for DuckDB.
SQL_DOCUMENTS = """c_doc AS (
  SELECT d.doc_id AS row_id, CAST(d.doc_id AS VARCHAR) AS source_id, d.text, d.n_chars, d.lang AS genre, d.source AS agent, d.source AS repo,
         CASE WHEN l.toxic = 1 THEN 'N3' WHEN l.quality = 0 THEN 'P' WHEN l.quality = 1 THEN 'N1' ELSE 'N2' END AS set
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
SQL_CONVERSATIONS = """c_conv AS (
  SELECT conv_id * 1000 + turn AS row_id, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS source_id, text, length(text) AS n_chars,
         'comment' AS genre, role AS agent, CAST(conv_id AS VARCHAR) AS repo,
         CASE role WHEN 'assistant' THEN 'P' WHEN 'user' THEN 'N1' ELSE 'N3' END AS set, CAST(floor(length(text) / 50) AS DOUBLE) AS score
  FROM conversations)"""
SQL_LINES = """c_line AS (
  SELECT o_orderpriority AS genre, o_orderstatus AS agent, l_linestatus AS ext,
         CASE l_returnflag WHEN 'R' THEN 'P' WHEN 'N' THEN 'N1' ELSE 'N3' END AS set, l_linenumber % 2 = 0 AS matched,
         CAST(floor(l_extendedprice) AS BIGINT) AS n_chars, u.detector, u.score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey,
  LATERAL (VALUES ('price', l_extendedprice), ('qty', l_quantity), ('discount', l_discount), ('tax', l_tax),
                  ('flag', CASE WHEN l_tax > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), ('probability', l_quantity / 50.0::DOUBLE)) u(detector, score))"""
