"""Allocation, matching, freeze and profile on the fixture views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.operators import sampling as S
from calibrant.plans import corpus as C
from calibrant.plans import views as V
from calibrant.queries._registry import Registry
from calibrant.sources.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_ORDER = "md5('7|' || CAST(row_id AS VARCHAR)), row_id"


@query(f"WITH {V.SQL_DOCUMENTS} SELECT row_id, agent, genre FROM (SELECT *, row_number() OVER (PARTITION BY agent, genre ORDER BY {_ORDER}) AS k FROM c_doc) WHERE k <= 10")
def smp_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.allocate(V.documents(spark, sf_dir), 10).select("row_id", "agent", "genre")


@query(f"WITH {V.SQL_DOCUMENTS} SELECT agent, genre, count(*) AS available, least(count(*), 10) AS sampled, count(*) < 12 AS below_floor FROM c_doc GROUP BY 1, 2")
def smp_allocate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.allocation_report(V.documents(spark, sf_dir), 10, 12)


@query(f'WITH {V.SQL_DOCUMENTS} SELECT row_id, "set", genre FROM (SELECT *, row_number() OVER (PARTITION BY "set", genre ORDER BY {_ORDER}) AS k FROM c_doc) WHERE k <= 25')
def smp_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.allocate(V.documents(spark, sf_dir), 25, ["set", "genre"]).select("row_id", "set", "genre")


@query("SELECT doc_id AS row_id FROM documents ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 40")
def smp_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.draw(V.documents(spark, sf_dir), 40, "row_id").select("row_id")


_BINS = ", ".join(f"quantile_cont(n_chars, {i / 10})" for i in range(1, 10))


def _matched_sql(view: str, name: str) -> str:
    return f"""WITH {view}, e AS (SELECT genre, list_distinct([{_BINS}]) AS edges FROM {name} WHERE "set" = 'P' GROUP BY 1),
    pos AS (SELECT genre, len(list_filter(edges, lambda x: x < n_chars)) + 1 AS bin FROM {name} JOIN e USING (genre) WHERE "set" = 'P'),
    neg AS (SELECT row_id, genre, len(list_filter(edges, lambda x: x < n_chars)) + 1 AS bin FROM {name} JOIN e USING (genre) WHERE "set" = 'N1'),
    want AS (SELECT genre, bin, count(*) AS wanted FROM pos GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY genre, bin ORDER BY {_ORDER}) AS k FROM neg)"""


@query(_matched_sql(V.SQL_DOCUMENTS, "c_doc") + " SELECT row_id, genre, CAST(bin AS INTEGER) AS bin FROM ranked JOIN want USING (genre, bin) WHERE k <= wanted")
def smp_match_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.documents(spark, sf_dir)
    matched, _ = S.match_lengths(docs.where("set = 'P'"), docs.where("set = 'N1'"))
    return matched.select("row_id", "genre", "bin")


@query(_matched_sql(V.SQL_CONVERSATIONS, "c_conv") + ", pool AS (SELECT genre, bin, count(*) AS n FROM neg GROUP BY 1, 2) SELECT genre, '' AS stratum, CAST(bin AS INTEGER) AS bin, wanted, least(wanted, coalesce(n, 0)) AS got FROM want LEFT JOIN pool USING (genre, bin) WHERE coalesce(n, 0) < wanted")
def smp_match_deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = V.conversations(spark, sf_dir)
    _, report = S.match_lengths(turns.where("set = 'P'"), turns.where("set = 'N1'"))
    return report


@query("""WITH w AS (SELECT lang, CAST(round_even(count(*) / (SELECT count(*) FROM documents WHERE source IN ('src0', 'src1')) * 60, 0) AS INTEGER) AS quota FROM documents WHERE source IN ('src0', 'src1') GROUP BY 1),
    p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents WHERE source NOT IN ('src0', 'src1')),
    picked AS (SELECT doc_id, lang FROM p JOIN w USING (lang) WHERE k <= quota),
    u AS (SELECT doc_id, lang, 0 AS f FROM picked UNION ALL SELECT doc_id, lang, 1 FROM p WHERE doc_id NOT IN (SELECT doc_id FROM picked))
    SELECT doc_id, lang AS language FROM u ORDER BY f, md5('7|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 60""")
def smp_quota_topup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "lang", "source"]).withColumnRenamed("lang", "language")
    first = F.col("source").isin("src0", "src1")
    return S.quota_draw(docs.where(~first).select("doc_id", "language"), docs.where(first), 60, "doc_id")


@query(f"""WITH {V.SQL_CONVERSATIONS}, g AS (SELECT *, CASE WHEN coalesce(repo, '') = '' THEN 'row:' || CAST(row_id AS VARCHAR) ELSE 'repo:' || repo END AS grp, CASE WHEN "set" = 'P' THEN 1 ELSE 0 END AS y FROM c_conv),
    z AS (SELECT grp, length(bin(count(*))) AS large, CAST((10 * sum(y)) // count(*) AS BIGINT) AS share FROM g GROUP BY 1),
    f AS (SELECT grp, (row_number() OVER (PARTITION BY large, share ORDER BY md5('7|' || grp), grp) + large + share) % 5 AS fold FROM z)
    SELECT row_id, repo, y, CAST(fold AS INTEGER) AS fold FROM g JOIN f USING (grp)""")
def smp_grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = V.conversations(spark, sf_dir).withColumn("y", (F.col("set") == "P").cast("int"))
    return S.grouped_folds(turns, "y", "repo", "row_id").select("row_id", "repo", "y", "fold")


@query(_matched_sql(V.SQL_DOCUMENTS, "c_doc") + f""", m AS (SELECT r.genre FROM ranked r JOIN want USING (genre, bin) WHERE k <= wanted),
    capped AS (SELECT "set", genre FROM (SELECT *, row_number() OVER (PARTITION BY "set", genre ORDER BY {_ORDER}) AS k FROM c_doc) WHERE k <= 60)
    SELECT "set", genre, matched, count(*) AS n FROM (SELECT "set", genre, CASE WHEN "set" = 'N1' THEN false END AS matched FROM capped UNION ALL SELECT 'N1', genre, true FROM m) GROUP BY 1, 2, 3""")
def corpus_freeze_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.documents(spark, sf_dir).withColumn("label", (F.col("set") == "P").cast("int"))
    frozen, _ = C.freeze([docs.where(F.col("set") == s) for s in ("P", "N1", "N2", "N3")], per_cell=60)
    return frozen.groupBy("set", "genre", "matched").agg(F.count("*").alias("n"))


@query(f"""WITH {V.SQL_DOCUMENTS} SELECT coalesce("set", 'all') AS "set", coalesce(genre, 'all') AS genre, count(*) AS n FROM c_doc GROUP BY GROUPING SETS (("set", genre), ("set"), ())""")
def agg_pivot_counts_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.set_totals(V.documents(spark, sf_dir))


@query(f"""WITH {V.SQL_DOCUMENTS} SELECT "set", count_if(genre = 'de') AS de, count_if(genre = 'en') AS en, count_if(genre = 'es') AS es, count_if(genre = 'fr') AS fr FROM c_doc GROUP BY 1""")
def agg_pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calibrant.plans.report import counts_by

    return counts_by(V.documents(spark, sf_dir), "set", "genre", ["de", "en", "es", "fr"])


@query("""SELECT source AS agent, count(*) AS n, count(DISTINCT lang) AS repos, min(doc_id) AS first, max(doc_id) AS last, round(100 * avg(CASE WHEN length(text) = 0 THEN 1.0 ELSE 0.0 END), 1) AS empty_pct,
    CAST(trunc(quantile_cont(length(text), 0.5)) AS INTEGER) AS median_chars, count_if(regexp_matches(text, '(?im)^\\s*(Summary|Test Plan|Bug|Fixes|Refs|Reviewers):')) AS boilerplate FROM documents GROUP BY 1""")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("agent"), F.col("lang").alias("repo"), F.col("doc_id").alias("created_at"), F.col("text").alias("body"))
    return C.profile(docs)
