"""Claim-and-evidence graph as a triple table, and its competency queries (GRF-01..12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.functions.structure import finite, node_id
from calibrant.operators.relational import keep_first
from calibrant.operators.sampling import draw_artifacts
from calibrant.plans.validity import CELL

#: Direct subclasses of the evidence classes.
SUBCLASSES = [("DeclaredEvidence", "Evidence"), ("TrailerEvidence", "DeclaredEvidence"), ("AgentAccountEvidence", "DeclaredEvidence"), ("PlatformMetadataEvidence", "DeclaredEvidence"), ("SelfAdmissionEvidence", "DeclaredEvidence"), ("DetectorEvidence", "Evidence")]


def closure(spark: SparkSession) -> DataFrame:
    """(child, ancestor), each class its own ancestor too (GRF-10)."""
    pairs = {(c, c) for pair in SUBCLASSES for c in pair} | set(SUBCLASSES)
    while more := {(a, d) for a, b in pairs for c, d in pairs if b == c} - pairs:
        pairs |= more
    return spark.createDataFrame(sorted(pairs), "child string, ancestor string")


def triples(corpus: DataFrame, scores: DataFrame, stratum: DataFrame, sample: int | None = None, seed: int = 7) -> DataFrame:
    """(s, p, o, o_type) of artifacts, declared and detector claims, and runs (GRF-01..04, SET-06).

    ``corpus``: source_id, genre, set, agent, repo, n_chars; ``scores``: source_id,
    genre, detector, version, score; ``stratum``: detector, genre, threshold,
    fpr_achieved, recall_at_fpr, youden_j. No sample means all artifacts.
    """
    artifacts = keep_first(corpus, ["source_id", "genre"], "set", "agent", "repo", "n_chars")
    if sample:
        artifacts = draw_artifacts(artifacts, sample, ["source_id", "genre"], seed)
        scores = scores.join(artifacts.select("source_id", "genre"), ["source_id", "genre"], "left_semi")
    ident = node_id(F.col("source_id"))

    def iri(kind: str, *parts: Column | str) -> Column:
        return F.concat_ws("/", F.lit(kind), *[F.col(p) if isinstance(p, str) else p for p in parts])

    def facts(df: DataFrame, *rows: tuple[Column, str, Column, str]) -> DataFrame:
        """One scan, one row per fact; facts with a null part are none."""
        structs = [F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(t).alias("o_type")) for s, p, o, t in rows]
        return df.select(F.explode(F.array(*structs)).alias("t")).select("t.*").where("s IS NOT NULL AND o IS NOT NULL")

    run = iri("run", "detector")
    runs = facts(scores.select("detector", "version").distinct(), (run, "type", F.lit("DetectionActivity"), "iri"), (run, "detector", F.col("detector"), "string"), (run, "detectorVersion", F.col("version"), "string"))
    art = iri("artifact", "genre", ident)
    described = facts(artifacts, (art, "type", F.lit("Artifact"), "iri"), (art, "genre", F.col("genre"), "string"), (art, "characterLength", F.col("n_chars").cast("long"), "integer"), (art, "repository", F.nullif(F.col("repo"), F.lit("")), "string"))
    agent, claim, evidence = iri("agent", "agent"), iri("claim/declared", "genre", ident), iri("evidence/declared", "genre", ident)
    declared = facts(
        artifacts.where((F.col("set") == "P") & F.col("agent").isNotNull()),
        (agent, "type", F.lit("CodingAgent"), "iri"), (agent, "tool", F.col("agent"), "string"), (claim, "type", F.lit("AuthorshipClaim"), "iri"), (claim, "claimAbout", art, "iri"),
        (claim, "claimsAgent", agent, "iri"), (claim, "hasEvidence", evidence, "iri"), (evidence, "type", F.lit("AgentAccountEvidence"), "iri"), (art, "wasAttributedTo", agent, "iri"),
    )
    flagged = scores.where(finite(F.col("score"))).join(F.broadcast(stratum), CELL).where("score >= threshold")
    claim, evidence = iri("claim/detected", "detector", "genre", ident), iri("evidence/detected", "detector", "genre", ident)
    detected = facts(
        flagged,
        (claim, "type", F.lit("AuthorshipClaim"), "iri"), (claim, "claimAbout", art, "iri"), (claim, "hasEvidence", evidence, "iri"), (evidence, "type", F.lit("DetectorEvidence"), "iri"),
        (evidence, "producedBy", run, "iri"), (evidence, "score", F.col("score"), "double"), (evidence, "threshold", F.col("threshold"), "double"),
        (evidence, "stratumFalsePositiveRate", F.col("fpr_achieved"), "double"), (evidence, "stratumSensitivity", F.col("recall_at_fpr"), "double"), (evidence, "stratumYoudenJ", F.when(finite(F.col("youden_j")), F.col("youden_j")), "double"),
    )
    return reduce(DataFrame.unionByName, [runs, described, declared, detected]).distinct()


def _edge(graph: DataFrame, predicate: str, subject: str, value: str) -> DataFrame:
    return graph.where(F.col("p") == predicate).select(F.col("s").alias(subject), F.col("o").alias(value))


def _typed(graph: DataFrame, kinds: DataFrame | str, subject: str) -> DataFrame:
    types = _edge(graph, "type", subject, "kind")
    return types.where(F.col("kind") == kinds).select(subject) if isinstance(kinds, str) else types.join(F.broadcast(kinds), "kind", "left_semi").select(subject)


def _claims(graph: DataFrame) -> DataFrame:
    """(claim, artifact, evidence)."""
    return _edge(graph, "claimAbout", "claim", "artifact").join(_edge(graph, "hasEvidence", "claim", "evidence"), "claim")


def detector_only(graph: DataFrame, entailed: bool = True) -> DataFrame:
    """Q1: artifacts known from detectors alone in strata with a rate over 5 percent, by genre and detector.

    Without entailment no evidence is of the declared superclass by its triples,
    so nothing is excluded; with it the subclass closure counts.
    """
    kinds = closure(graph.sparkSession) if entailed else graph.sparkSession.createDataFrame([("DeclaredEvidence", "DeclaredEvidence")], "child string, ancestor string")
    declared_kinds = kinds.where("ancestor = 'DeclaredEvidence'").select(F.col("child").alias("kind"))
    claims = _claims(graph)
    declared = claims.join(_typed(graph, declared_kinds, "evidence"), "evidence", "left_semi").select("artifact").distinct()
    rate = _edge(graph, "stratumFalsePositiveRate", "evidence", "fpr").withColumn("fpr", F.col("fpr").cast("double")).where("fpr > 0.05")
    found = claims.join(_typed(graph, "DetectorEvidence", "evidence"), "evidence", "left_semi").join(rate, "evidence").join(_produced(graph), "evidence").join(_edge(graph, "genre", "artifact", "genre"), "artifact")
    return found.join(declared, "artifact", "left_anti").groupBy("genre", "detector").agg(F.count_distinct("artifact").alias("artifacts"), F.avg("fpr").alias("stratum_fpr"))


def _produced(graph: DataFrame) -> DataFrame:
    """(evidence, detector) along producedBy / detector."""
    names = _edge(graph, "detector", "run", "detector")  # a handful of runs
    return _edge(graph, "producedBy", "evidence", "run").join(F.broadcast(names), "run").drop("run")


def evidence_mix(graph: DataFrame) -> DataFrame:
    """Q2: evidence by genre and type."""
    return _claims(graph).join(_edge(graph, "type", "evidence", "evidence_type"), "evidence").join(_edge(graph, "genre", "artifact", "genre"), "artifact").groupBy("genre", "evidence_type").agg(F.count("*").alias("n"))


def declared_undetected(graph: DataFrame) -> DataFrame:
    """Q3: declared artifacts that no detector flagged, by genre."""
    claims = _claims(graph)
    detected = claims.join(_typed(graph, "DetectorEvidence", "evidence"), "evidence", "left_semi").select("artifact").distinct()
    declared = claims.join(_typed(graph, "AgentAccountEvidence", "evidence"), "evidence", "left_semi").select("artifact").distinct()
    return declared.join(detected, "artifact", "left_anti").join(_edge(graph, "genre", "artifact", "genre"), "artifact").groupBy("genre").agg(F.count_distinct("artifact").alias("declared_undetected"))


def uninformative(graph: DataFrame, most: float = 0.05) -> DataFrame:
    """Q4: evidence from strata with J of at most 0.05, by detector and genre."""
    j = _edge(graph, "stratumYoudenJ", "evidence", "j").withColumn("j", F.col("j").cast("double")).where(F.col("j") <= most)
    found = _claims(graph).join(_typed(graph, "DetectorEvidence", "evidence"), "evidence", "left_semi").join(j, "evidence").join(_produced(graph), "evidence").join(_edge(graph, "genre", "artifact", "genre"), "artifact")
    return found.groupBy("detector", "genre").agg(F.count("*").alias("claims"), F.avg("j").alias("youden_j"))


def agreement(graph: DataFrame) -> DataFrame:
    """Q5: declared artifacts of each tool, and how many a detector flagged too."""
    claims = _claims(graph)
    tools = _edge(graph, "claimsAgent", "claim", "agent").join(_edge(graph, "tool", "agent", "tool"), "agent")
    declared = claims.join(_typed(graph, "AgentAccountEvidence", "evidence"), "evidence", "left_semi").join(tools, "claim").select("tool", "artifact")
    detected = claims.join(_typed(graph, "DetectorEvidence", "evidence"), "evidence", "left_semi").select("artifact", F.col("artifact").alias("also")).distinct()
    return declared.join(detected, "artifact", "left").groupBy("tool").agg(F.count_distinct("artifact").alias("declared"), F.count_distinct("also").alias("also_flagged"))


def typed_subjects(graph: DataFrame) -> DataFrame:
    """Subjects per type (GRF-11)."""
    return _edge(graph, "type", "s", "kind").groupBy("kind").agg(F.count_distinct("s").alias("subjects"))


COMPETENCY = {"q1": detector_only, "q2": evidence_mix, "q3": declared_undetected, "q4": uninformative, "q5": agreement}


def answers(graph: DataFrame) -> dict[str, bool]:
    """Whether each competency query finds anything; an empty one is a failure (GRF-12)."""
    return {name: not query(graph).isEmpty() for name, query in COMPETENCY.items()}
