"""Digest queries of the operators over the fixture tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.llm import decontaminate, line_crf, line_dedup, pii, quality_rules, sentencepiece_codec, simhash, substring_dedup, token_counts, warc
from calibrant.llm._state import drop_folder, keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from its lines, learnt from rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = line_crf.train(docs, labels, where=~line_crf.held_out("doc"))
    scored = line_crf.score(docs, model, drop_text=True)
    return scored.select("doc_id", line_crf.held_out().alias("held_out"), "score", "predicted")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, _table(spark, sf_dir, "benchmark"))
    items = F.size("hit_items").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"]).alias("n_hit"),
        items.alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        (items >= 2).alias("contaminated"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines that other documents keep."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.remove(docs).select("doc_id", "text")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.cluster(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level token counts of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.train(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model).drop("text")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back; an archive that does not read back whole fails the query."""
    folder = warc.archive_folder(spark)
    records = warc.plan_records(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    manifest = warc.write_archives(records, folder)
    read = warc.read_archives(spark, folder, manifest, payloads=False)
    result = keep(read.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "problem"))
    warc.require_whole(result, manifest)
    drop_folder(spark, folder)
    return result.drop("problem")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that also begin elsewhere."""
    return substring_dedup.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality_crf": op2_quality_crf,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash": op5_simhash,
    "op6_token_counts": op6_token_counts,
    "op7_quality_rules": op7_quality_rules,
    "op8_pii": op8_pii,
    "op9_warc": op9_warc,
    "op10_substring_dedup": op10_substring_dedup,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

ORACLES: dict[str, str] = {
    "op3_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_LOWERED} AS w FROM documents), b AS (SELECT item_id, {_LOWERED} AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
               FROM (SELECT item_id, w, least(8, len(w)) AS k FROM b WHERE len(w) > 0)),
        dw AS (SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g, unnest(range(1, len(w) - k + 2)) AS i
               FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k),
        h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, g)),
        c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY 1),
        t AS (SELECT doc_id, count(*) AS n_items, sha256(array_to_string(list_sort(list(CAST(item_id AS VARCHAR))), ',')) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op4_line_dedup": """
        WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
        x AS (SELECT line, min(doc_id) AS keeper FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1 HAVING count(DISTINCT source) >= 10),
        n AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
        k AS (SELECT doc_id, string_agg(n.line, chr(10) ORDER BY i) AS text FROM n LEFT JOIN x ON n.line = x.line WHERE x.line IS NULL OR n.doc_id = x.keeper GROUP BY 1)
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text FROM documents d LEFT JOIN k USING (doc_id)""",
    "op9_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS html FROM pages),
        f AS (SELECT html, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN top IS NOT NULL AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
        FROM p LEFT JOIN f USING (html)""",
    "op10_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        x AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: sha256(array_to_string(w[i:i + 34], ' ')))) AS h FROM d WHERE len(w) >= 35),
        r AS (SELECT h FROM x GROUP BY 1 HAVING count(*) > 1),
        c AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM x JOIN r USING (h)) GROUP BY 1),
        e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
        g AS (SELECT doc_id, unnest(gone) AS j FROM c),
        k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.j) AS kept FROM e ANTI JOIN g ON e.doc_id = g.doc_id AND e.j = g.j GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)""",
}
