"""Provenance graph and streaming on the conversation and event fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.plans import provenance as P
from calibrant.plans import views as V
from calibrant.queries._registry import Registry
from calibrant.sources.tables import table
from calibrant.streaming import resume

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

#: A stratum table for two length detectors over the turns.
STRATA = [("len50", "comment", 10.0, 0.2, 0.6, 0.4), ("len100", "comment", 8.0, 0.02, 0.03, 0.01)]
_STRATA_SQL = ", ".join(f"('{d}', '{g}', {t}::DOUBLE, {f}::DOUBLE, {r}::DOUBLE, {j}::DOUBLE)" for d, g, t, f, r, j in STRATA)


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = V.conversations(spark, sf_dir)
    n = F.col("n_chars")
    scores = turns.select("source_id", "genre", F.lit("v1").alias("version"), F.explode(F.create_map(F.lit("len50"), F.floor(n / 50).cast("double"), F.lit("len100"), F.floor(n / 100).cast("double"))).alias("detector", "score"))
    stratum = spark.createDataFrame(STRATA, "detector string, genre string, threshold double, fpr_achieved double, recall_at_fpr double, youden_j double")
    return P.triples(turns, scores, stratum)


_CLAIMS = f"""{V.SQL_CONVERSATIONS}, st AS (SELECT * FROM (VALUES {_STRATA_SQL}) v(detector, genre, threshold, fpr, se, j)),
  sc AS (SELECT source_id, genre, 'len50' AS detector, floor(n_chars / 50) AS score FROM c_conv UNION ALL SELECT source_id, genre, 'len100', floor(n_chars / 100) FROM c_conv),
  det AS (SELECT DISTINCT source_id, genre, detector, fpr, j FROM sc JOIN st USING (detector, genre) WHERE score >= threshold),
  dec AS (SELECT DISTINCT source_id, genre, agent FROM c_conv WHERE "set" = 'P')"""


@query(f"""WITH {_CLAIMS}, art AS (SELECT DISTINCT source_id, genre FROM c_conv)
    SELECT CAST(2 * 3 + (SELECT 4 * count(*) FROM art) + (SELECT 6 * count(*) FROM dec) + (SELECT 2 * count(DISTINCT agent) FROM dec) + (SELECT 10 * count(*) FROM det) AS BIGINT) AS n""")
def kg_triples_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).agg(F.count("*").alias("n"))


@query(f"WITH {_CLAIMS} SELECT genre, detector, count(DISTINCT source_id) AS artifacts, round(avg(fpr), 9) AS stratum_fpr FROM det WHERE fpr > 0.05 GROUP BY 1, 2")
def kg_q1_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.detector_only(_graph(spark, sf_dir), entailed=False).withColumn("stratum_fpr", F.round("stratum_fpr", 9))


@query(f"WITH {_CLAIMS} SELECT genre, detector, count(DISTINCT source_id) AS artifacts, round(avg(fpr), 9) AS stratum_fpr FROM det WHERE fpr > 0.05 AND (source_id, genre) NOT IN (SELECT (source_id, genre) FROM dec) GROUP BY 1, 2".replace("(source_id, genre) NOT IN (SELECT (source_id, genre) FROM dec)", "NOT EXISTS (SELECT 1 FROM dec WHERE dec.source_id = det.source_id AND dec.genre = det.genre)"))
def kg_q1_entailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.detector_only(_graph(spark, sf_dir)).withColumn("stratum_fpr", F.round("stratum_fpr", 9))


@query(f"WITH {_CLAIMS} SELECT genre, 'AgentAccountEvidence' AS evidence_type, count(*) AS n FROM dec GROUP BY 1 UNION ALL SELECT genre, 'DetectorEvidence', count(*) FROM det GROUP BY 1")
def kg_q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.evidence_mix(_graph(spark, sf_dir))


@query(f"WITH {_CLAIMS} SELECT genre, count(DISTINCT source_id) AS declared_undetected FROM dec WHERE NOT EXISTS (SELECT 1 FROM det WHERE dec.source_id = det.source_id AND dec.genre = det.genre) GROUP BY 1")
def kg_q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.declared_undetected(_graph(spark, sf_dir))


@query(f"WITH {_CLAIMS} SELECT detector, genre, count(*) AS claims, round(avg(j), 9) AS youden_j FROM det WHERE j <= 0.05 GROUP BY 1, 2")
def kg_q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.uninformative(_graph(spark, sf_dir)).withColumn("youden_j", F.round("youden_j", 9))


@query(f"WITH {_CLAIMS} SELECT agent AS tool, count(DISTINCT dec.source_id) AS declared, count(DISTINCT det.source_id) AS also_flagged FROM dec LEFT JOIN det ON dec.source_id = det.source_id AND dec.genre = det.genre GROUP BY 1")
def kg_q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.agreement(_graph(spark, sf_dir))


@query(f"""WITH {_CLAIMS}, n AS (SELECT (SELECT count(*) FROM dec) AS d, (SELECT count(*) FROM det) AS e, (SELECT count(DISTINCT source_id) FROM c_conv) AS a, (SELECT count(DISTINCT agent) FROM dec) AS g)
    SELECT kind, subjects FROM (SELECT unnest(['Artifact', 'AuthorshipClaim', 'AgentAccountEvidence', 'DetectorEvidence', 'DetectionActivity', 'CodingAgent']) AS kind, unnest([a, d + e, d, e, 2, g]) AS subjects FROM n) WHERE subjects > 0""")
def kg_typed_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.typed_subjects(_graph(spark, sf_dir))


@query("""SELECT ancestor, count(*) AS n FROM (VALUES ('Evidence'), ('Evidence'), ('Evidence'), ('Evidence'), ('Evidence'), ('Evidence'), ('Evidence'), ('DeclaredEvidence'), ('DeclaredEvidence'), ('DeclaredEvidence'), ('DeclaredEvidence'), ('DeclaredEvidence'), ('TrailerEvidence'), ('AgentAccountEvidence'), ('PlatformMetadataEvidence'), ('SelfAdmissionEvidence'), ('DetectorEvidence')) v(ancestor) GROUP BY 1""")
def kg_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.closure(spark).groupBy("ancestor").agg(F.count("*").alias("n"))


@query("""SELECT user_id, version, value FROM (SELECT user_id, event_id AS version, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1""")
def stm_resume_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, landed once and merged by user."""
    folder = f"{resume.shared_folder(spark)}/upsert-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    source = stream.select("user_id", F.col("event_id").alias("version"), "value")
    resume.land(source, f"{folder}/log", resume.upsert_into(spark, f"{folder}/table", ["user_id"], "version"))
    return resume.latest(spark, f"{folder}/table")


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END), 9) AS rate FROM events GROUP BY 1, 2""")
def stm_flag_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resume.flag_rates(table(spark, sf_dir, "events"), 50.0)
    return found.withColumns({"start": F.col("start").cast("timestamp_ntz"), "rate": F.round("rate", 9)})
