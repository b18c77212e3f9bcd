"""Validity and correction on the line view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.detectors import rules
from calibrant.functions import stats as S
from calibrant.operators.relational import coverage, partially_scored
from calibrant.plans import correction as C
from calibrant.plans import validity as M
from calibrant.plans import views as V
from calibrant.queries._registry import Registry
from calibrant.sources.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_PAIRS = """, s AS (SELECT {keys}, score, sum(CASE WHEN {pos} THEN 1 ELSE 0 END) AS p, sum(CASE WHEN {neg} THEN 1 ELSE 0 END) AS n FROM {view} WHERE score IS NOT NULL GROUP BY {keys}, score)"""
_POS, _N1 = "\"set\" = 'P'", "(\"set\" = 'N1' AND matched)"


def _auroc_sql(keys: str, pos: str = _POS, neg: str = _N1, name: str = "auroc") -> str:
    """By ranks over all rows of both sides, ties averaged: independent of the engine's running totals."""
    return f"""(SELECT {keys}, round((sum(CASE WHEN side = 1 THEN rk END) - count_if(side = 1) * (count_if(side = 1) + 1) / 2) / nullif(count_if(side = 1) * count_if(side = 0), 0), 9) AS {name}
      FROM (SELECT {keys}, side, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2 AS rk
            FROM (SELECT {keys}, score, CASE WHEN {pos} THEN 1 ELSE 0 END AS side FROM c_line WHERE score IS NOT NULL AND ({pos} OR {neg}))) GROUP BY {keys})"""


_POINT = f"""(WITH s AS (SELECT detector, genre, score, count_if({_POS}) AS p, count_if({_N1}) AS n FROM c_line WHERE {_POS} OR {_N1} GROUP BY 1, 2, 3),
      w AS (SELECT detector, genre, score, sum(n) OVER d / sum(n) OVER a AS fpr, sum(p) OVER d / sum(p) OVER a AS recall FROM s WINDOW d AS (PARTITION BY detector, genre ORDER BY score DESC), a AS (PARTITION BY detector, genre)),
      c AS (SELECT detector, genre, coalesce(min(CASE WHEN fpr <= 0.05 THEN score END), max(score)) AS threshold FROM w GROUP BY 1, 2)
      SELECT w.detector, w.genre, threshold, fpr, recall FROM w JOIN c ON w.detector = c.detector AND w.genre = c.genre AND w.score = c.threshold)"""


def _weight(count: str, names: str) -> str:
    """A Poisson draw by the hash of ``names``, as the engine draws it."""
    u = [f"((CAST(('0x' || substr(md5({names}), {k}, 8)) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE)" for k in (1, 9)]
    z = f"greatest(sqrt(-2.0::DOUBLE * ln({u[0]})) * cos(6.283185307179586::DOUBLE * {u[1]}), -3.0::DOUBLE * sqrt(CAST({count} AS DOUBLE)))"
    return f"CASE WHEN {count} = 0 THEN 0.0::DOUBLE ELSE list_transform([{z}], lambda z: greatest(floor({count} + sqrt(CAST({count} AS DOUBLE)) * z + (z * z - 1.0::DOUBLE) / 6.0::DOUBLE + 0.5::DOUBLE), 0.0::DOUBLE))[1] END"


def _interval_sql(keys: str, source: str, pos: str = _POS, neg: str = _N1, low: str = "ci_lo", high: str = "ci_hi", replicates: int = 500, digits: int = 7) -> str:
    """Percentiles of resampled AUROC, written with windows over all scores and replicates."""
    names = " || '|' || ".join(f"CAST({k.strip()} AS VARCHAR)" for k in keys.split(","))
    draw = {side: _weight(side, f"'7|' || {names} || '|{side}|' || b || '|' || r") for side in "pn"}
    return f"""(WITH zs AS (SELECT {keys}, score, count_if({pos}) AS p, count_if({neg}) AS n FROM {source} WHERE score IS NOT NULL AND ({pos} OR {neg}) GROUP BY {keys}, score),
      zw AS (SELECT *, sum(p + n) OVER o - (p + n) AS tb, sum(p + n) OVER (PARTITION BY {keys}) AS t, sum(n) OVER o - n AS nb FROM zs WINDOW o AS (PARTITION BY {keys} ORDER BY score)),
      zr AS (SELECT {keys}, CAST(floor(tb * {S.RANGES} / t) AS INTEGER) AS r, CAST(sum(p) AS BIGINT) AS p, CAST(sum(n) AS BIGINT) AS n, CAST(sum(p * (2 * nb + n)) - 2 * sum(p) * min(nb) AS BIGINT) AS tw FROM zw GROUP BY {keys}, r),
      zx AS (SELECT *, {draw['p']} AS wp, {draw['n']} AS wn FROM zr, range(1, {replicates + 1}) g(b)),
      zy AS (SELECT *, sum(wn) OVER (PARTITION BY {keys}, b ORDER BY r) - wn AS c FROM zx),
      zv AS (SELECT {keys}, b, sum(wp * (2 * c + wn * CASE WHEN p * n > 0 THEN CAST(tw AS DOUBLE) / (p * n) ELSE 0 END)) / nullif(2 * sum(wp) * sum(wn), 0) AS v FROM zy GROUP BY {keys}, b)
      SELECT {keys}, round(quantile_cont(v, 0.025), {digits}) AS {low}, round(quantile_cont(v, 0.975), {digits}) AS {high} FROM zv GROUP BY {keys})"""


def _bounds_to(df: DataFrame, digits: int = 7) -> DataFrame:
    """Bounds of resamples to fewer digits: they sum up in any order."""
    return df.select(*[F.round(c, digits).alias(c) if c.endswith(("_lo", "_hi")) else F.col(c) for c in df.columns])


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {V.SQL_LINES} SELECT * FROM {_auroc_sql('detector, genre')}")
def stat_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = S.score_counts(V.lines(spark, sf_dir), M.CELL, S.is_positive(), S.is_matched())
    return _rounded(S.auroc(counts, M.CELL))


@query(f"WITH {V.SQL_LINES} SELECT * FROM {_auroc_sql('detector, genre', neg=chr(34) + 'set' + chr(34) + ' = ' + chr(39) + 'N3' + chr(39), name='auroc_n2')}")
def stat_auroc_n2(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = S.score_counts(V.lines(spark, sf_dir), M.CELL, S.is_positive(), F.col("set") == "N3")
    return _rounded(S.auroc(counts, M.CELL, name="auroc_n2"))


_HEURISTIC = " + ".join(f"CAST(regexp_matches(text, {chr(39)}{'(?' + ''.join(c for c in f if c in 'im') + ')' if set(f) & set('im') else ''}{p.replace(chr(39), chr(39) * 2)}{chr(39)}) AS INTEGER)" for _, f, p in rules.RULES)


@query(f"""WITH {V.SQL_DOCUMENTS}, s AS (SELECT genre, ({_HEURISTIC}) / 13.0::DOUBLE AS score, "set" FROM c_doc WHERE "set" IN ('P', 'N1')),
    g AS (SELECT genre, score, count_if("set" = 'P') AS p, count_if("set" = 'N1') AS n FROM s GROUP BY 1, 2),
    u AS (SELECT a.genre, sum(a.p * (CASE WHEN b.score < a.score THEN 2 * b.n WHEN b.score = a.score THEN b.n ELSE 0 END)) AS twice FROM g a JOIN g b ON a.genre = b.genre GROUP BY 1),
    t AS (SELECT genre, sum(p) AS np, sum(n) AS nn FROM g GROUP BY 1 HAVING sum(p) > 0 AND sum(n) > 0),
    w AS (SELECT a.genre, a.score, sum(b.n) / any_value(nn) AS fpr, sum(b.p) / any_value(np) AS recall FROM g a JOIN g b ON a.genre = b.genre AND b.score >= a.score JOIN t ON t.genre = a.genre GROUP BY 1, 2),
    c AS (SELECT genre, coalesce(min(CASE WHEN fpr <= 0.05 THEN score END), max(score)) AS thr FROM w GROUP BY 1)
    SELECT t.genre, CAST(np AS BIGINT) AS n_pos, CAST(nn AS BIGINT) AS n_neg, round(twice / (2 * np * nn), 9) AS auroc, round(thr, 9) AS threshold, round(fpr, 9) AS fpr, round(recall, 9) AS recall
    FROM t JOIN u USING (genre) JOIN c USING (genre) JOIN w ON w.genre = t.genre AND w.score = c.thr""")
def stat_operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule scores of the documents: AUROC and operating point per language."""
    docs = V.documents(spark, sf_dir).where("set IN ('P', 'N1')").withColumn("score", rules.heuristics(F.col("text")))
    counts = S.score_counts(docs, ["genre"], S.is_positive(), F.col("set") == "N1")
    sizes = counts.groupBy("genre").agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    return _rounded(sizes.join(S.auroc(counts, ["genre"]), "genre").join(S.operating_point(counts, ["genre"]), "genre"))


@query(f"""WITH {V.SQL_LINES} SELECT detector, round(avg(CASE WHEN "set" = 'N1' AND score IS NOT NULL THEN CASE WHEN score >= 0.06 THEN 1.0 ELSE 0.0 END END), 9) AS rate FROM c_line GROUP BY 1""")
def stat_rate_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.lines(spark, sf_dir).groupBy("detector").agg(S.rate_at(F.col("set") == "N1", F.col("score"), F.lit(0.06)).alias("rate")))


@query(f"""WITH {V.SQL_LINES}, o AS (SELECT * FROM {_POINT}),
    z AS (SELECT detector, genre, count_if({_POS}) AS n_pos, count_if({_N1}) AS n_neg, count(DISTINCT CASE WHEN {_POS} THEN score END) AS distinct_scores FROM c_line GROUP BY 1, 2),
    f AS (SELECT detector, genre, avg(CASE WHEN "set" = 'N1' THEN CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END END) AS a, avg(CASE WHEN "set" = 'N3' THEN CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END END) AS b FROM c_line JOIN o USING (detector, genre) GROUP BY 1, 2)
    SELECT detector, genre, n_pos, n_neg, distinct_scores, auroc_n1, ci_lo, ci_hi, CAST(NULL AS DOUBLE) AS auroc_n2, CAST(NULL AS DOUBLE) AS ci_n2_lo, CAST(NULL AS DOUBLE) AS ci_n2_hi, round(threshold, 9) AS threshold, round(fpr, 9) AS fpr_achieved, round(recall, 9) AS recall_at_fpr, round(a, 9) AS fpr_n1_unmatched, round(b, 9) AS fpr_n3_bots
    FROM z JOIN {_auroc_sql('detector, genre', name='auroc_n1')} USING (detector, genre) JOIN {_interval_sql('detector, genre', 'c_line')} USING (detector, genre) JOIN o USING (detector, genre) JOIN f USING (detector, genre)""")
def stat_rq1_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_bounds_to(M.metrics(V.lines(spark, sf_dir))))


@query(f"""WITH {V.SQL_LINES}, l AS (SELECT * REPLACE (CASE WHEN "set" = 'N3' THEN 'N2' ELSE "set" END AS "set") FROM c_line)
    SELECT * FROM {_auroc_sql('detector, genre', neg='"set" = ' + chr(39) + 'N3' + chr(39), name='auroc_n2')} JOIN {_interval_sql('detector, genre', 'l', neg='"set" = ' + chr(39) + 'N2' + chr(39), low='ci_n2_lo', high='ci_n2_hi')} USING (detector, genre)""")
def stat_rq1_contemporary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's AUROC and interval against contemporary people."""
    lines = V.lines(spark, sf_dir).withColumn("set", F.when(F.col("set") == "N3", "N2").otherwise(F.col("set")))
    return _rounded(_bounds_to(M.metrics(lines).select(*M.CELL, "auroc_n2", "ci_n2_lo", "ci_n2_hi")))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.conversations(spark, sf_dir).withColumns({"detector": F.lit("len"), "matched": F.col("set") == "N1"})


_TURNS = """t AS (SELECT 'len' AS detector, genre, "set", score, "set" = 'N1' AS matched FROM c_conv)"""


@query(f"""WITH {V.SQL_CONVERSATIONS}, {_TURNS} SELECT * FROM {_auroc_sql('detector, genre').replace('c_line', 't')} JOIN {_interval_sql('detector, genre', 't')} USING (detector, genre)""")
def stat_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_bounds_to(M.bootstrap_interval(_turns(spark, sf_dir))))


@query(f"""WITH {V.SQL_LINES}, u AS (SELECT * FROM c_line WHERE {_POS} OR {_N1}), e AS (SELECT detector, genre, [{', '.join(f'quantile_cont(n_chars, {i / 5})' for i in range(1, 5))}] AS edges FROM u GROUP BY 1, 2),
    c AS (SELECT u.*, len(list_filter(edges, lambda x: x < n_chars)) + 1 AS bin, edges FROM u JOIN e USING (detector, genre)),
    r AS (SELECT *, rank() OVER (PARTITION BY detector, genre, bin ORDER BY score) + (count(*) OVER (PARTITION BY detector, genre, bin, score) - 1) / 2 AS rk FROM c)
    SELECT * FROM (SELECT detector, genre, CAST(bin AS INTEGER) AS bin, CAST(CASE WHEN bin = 1 THEN 0 ELSE trunc(round(any_value(edges)[bin - 1], 6)) END AS INTEGER) AS chars_from, CAST(CASE WHEN bin = 5 THEN -1 ELSE trunc(round(any_value(edges)[bin], 6)) END AS INTEGER) AS chars_to, count_if({_POS}) AS n_pos,
    round((sum(CASE WHEN {_POS} THEN rk END) - count_if({_POS}) * (count_if({_POS}) + 1) / 2) / (count_if({_POS}) * count_if({_N1})), 9) AS auroc FROM r GROUP BY detector, genre, bin HAVING count_if({_POS}) >= 10 AND count_if({_N1}) >= 10) JOIN {_interval_sql('detector, genre, bin', 'c')} USING (detector, genre, bin)""")
def stat_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_bounds_to(M.by_length(V.lines(spark, sf_dir), cell_floor=20, bin_floor=10)))


@query(f"""WITH {V.SQL_LINES}, a AS (SELECT DISTINCT detector, genre, agent FROM c_line WHERE {_POS}),
    s AS (SELECT detector, genre, agent, score, 1 AS side FROM c_line WHERE {_POS} UNION ALL SELECT detector, genre, a.agent, score, 0 FROM c_line JOIN a USING (detector, genre) WHERE {_N1}),
    r AS (SELECT *, rank() OVER (PARTITION BY detector, genre, agent ORDER BY score) + (count(*) OVER (PARTITION BY detector, genre, agent, score) - 1) / 2 AS rk FROM s)
    SELECT * FROM (SELECT detector, genre, agent, count_if(side = 1) AS n_pos, round((sum(CASE WHEN side = 1 THEN rk END) - count_if(side = 1) * (count_if(side = 1) + 1) / 2) / (count_if(side = 1) * count_if(side = 0)), 9) AS auroc FROM r GROUP BY 1, 2, 3 HAVING count_if(side = 1) >= 5 AND count_if(side = 0) >= 20) JOIN {_interval_sql('detector, genre, agent', 's', 'side = 1', 'side = 0')} USING (detector, genre, agent)""")
def stat_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_bounds_to(M.by_agent(V.lines(spark, sf_dir), floor=5, negatives=20)))


@query(f"""WITH {V.SQL_LINES}, z AS (SELECT detector, ext, count_if({_POS}) AS n_pos, count_if({_N1}) AS n_neg FROM c_line GROUP BY 1, 2 HAVING count_if({_POS}) >= 1 AND count_if({_N1}) >= 1)
    SELECT * FROM z LEFT JOIN {_auroc_sql('detector, ext')} USING (detector, ext) LEFT JOIN {_interval_sql('detector, ext', 'c_line')} USING (detector, ext)""")
def stat_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_bounds_to(M.by_language(V.lines(spark, sf_dir), floor=1, genre=None)))


@query(f"""WITH {V.SQL_LINES}, o AS (SELECT * FROM {_POINT}), f AS (SELECT detector, genre, count(*) AS n_bots, avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) AS b FROM c_line JOIN o USING (detector, genre) WHERE "set" = 'N3' GROUP BY 1, 2)
    SELECT detector, genre, n_bots, round(fpr, 9) AS fpr_human, round(b, 9) AS fpr_bots, round(b / nullif(fpr, 0), 9) AS ratio, round(recall, 9) AS recall_agents FROM o JOIN f USING (detector, genre)""")
def stat_automation_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.automation_gap(V.lines(spark, sf_dir), floor=10))


_PUBLISHED = {"discount": 0.08, "probability": 0.9, "tax": 0.07}
_PUBLISHED_SQL = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _PUBLISHED.items())


@query(f"""WITH {V.SQL_LINES}, t AS (SELECT * FROM (VALUES {_PUBLISHED_SQL}) v(detector, threshold)),
    r AS (SELECT detector, genre, threshold, avg(CASE WHEN {_N1} THEN CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END END) AS f, avg(CASE WHEN {_POS} THEN CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END END) AS r, avg(CASE WHEN "set" = 'N3' THEN CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END END) AS b FROM c_line JOIN t USING (detector) GROUP BY 1, 2, 3)
    SELECT detector, genre, threshold, round(f, 9) AS fpr_prellm, round(r, 9) AS recall_agents, round(b, 9) AS fpr_bots, round(r - f, 9) AS youden_j FROM r""")
def stat_published_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.published_points(V.lines(spark, sf_dir), _PUBLISHED))


@query(f"""WITH {V.SQL_LINES}, u AS (SELECT detector, genre, score, CASE WHEN {_POS} THEN 1 ELSE 0 END AS y, greatest(len(list_filter([0.0, 0.1, 0.2, 0.3::DOUBLE, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[], lambda e: e < score)), 1) AS bin FROM c_line WHERE detector = 'probability' AND ({_POS} OR {_N1})),
    g AS (SELECT detector, genre, bin, count(*) AS k, sum(score) AS s, sum(y) AS y FROM u GROUP BY 1, 2, 3)
    SELECT detector, genre, CAST(sum(k) AS BIGINT) AS n, round(sum(y) / sum(k), 9) AS base_rate, round(sum(abs(s - y)) / sum(k), 9) AS ece, round(sum(s - y) / sum(k), 9) AS signed_gap FROM g GROUP BY 1, 2""".replace("0.3::DOUBLE", "0.30000000000000004").replace("0.6, 0.7", "0.6000000000000001, 0.7000000000000001"))
def stat_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.calibration(V.lines(spark, sf_dir), ["probability"], floor=10))


@query("""SELECT p_partkey, round(CASE WHEN se + sp - 1 > 0 THEN greatest(0, least(1, (0.2 + sp - 1) / (se + sp - 1))) END, 9) AS point FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS se, 0.95::DOUBLE AS sp FROM part)""")
def stat_rogan_gladen(spark: SparkSession, sf_dir: str) -> DataFrame:
    se = F.col("p_size") / F.lit(50.0)
    return _rounded(table(spark, sf_dir, "part").select("p_partkey", S.rogan_gladen(F.lit(0.2), se, F.lit(0.95)).alias("point")))


_GRID = ", ".join(f"('ap{round(a * 100):02d}', {a}::DOUBLE)" for a in C.GRID)
_RQ3 = f"""o AS (SELECT detector, genre, recall AS se, 1 - fpr AS sp FROM {_POINT}), q AS (SELECT detector, genre, se, sp, ap, a, CASE WHEN se + sp - 1 > 0 THEN (a + sp - 1) / (se + sp - 1) END AS raw FROM o, (VALUES {_GRID}) g(ap, a))"""


_FOUR = ", ".join(f"{_weight(c, chr(39) + '7|' + chr(39) + f' || detector || {chr(39)}|{chr(39)} || genre || {chr(39)}|{c}|{chr(39)} || b')} AS {c}" for c in ("ph", "pm", "nh", "nm"))


def _rates_sql(source: str, point: str) -> str:
    """se and sp of 1,000 resamples of each cell's four counts at its threshold."""
    return f"""h AS (SELECT detector, genre, count_if({_POS} AND score >= threshold) AS ph, count_if({_POS} AND score < threshold) AS pm, count_if({_N1} AND score >= threshold) AS nh, count_if({_N1} AND score < threshold) AS nm FROM {source} JOIN {point} USING (detector, genre) GROUP BY 1, 2),
      hb AS (SELECT detector, genre, b, {_FOUR} FROM h, range(1, 1001) g(b)), rates AS (SELECT detector, genre, b, ph / (ph + pm) AS rse, nm / (nh + nm) AS rsp FROM hb)"""


@query(f"""WITH {V.SQL_LINES}, {_RQ3}, {_rates_sql('c_line', _POINT)},
    ra AS (SELECT detector, genre, ap, CASE WHEN rse + rsp - 1 > 0 THEN greatest(0, least(1, (a + rsp - 1) / (rse + rsp - 1))) END AS v FROM rates, (VALUES {_GRID}) g(ap, a)),
    rb AS (SELECT detector, genre, ap, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 6) AS undefined FROM ra GROUP BY 1, 2, 3)
    SELECT detector, genre, round(se, 9) AS sensitivity, round(sp, 9) AS specificity, round(se + sp - 1, 9) AS youden_j, ap, lo, hi, undefined, round(raw, 6) AS raw, round(CASE WHEN raw IS NOT NULL THEN greatest(0, least(1, raw)) END, 6) AS point, CASE WHEN raw IS NULL THEN 'undefined' WHEN raw > 1 THEN 'out of range' ELSE 'estimable' END AS status FROM q JOIN rb USING (detector, genre, ap)""")
def stat_rq3_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = C.long_form(C.corrected(V.lines(spark, sf_dir), floor=10))
    return _rounded(long.withColumns({c: F.round(c, 6) for c in ("raw", "point", "lo", "hi", "undefined")}))


@query(f"""WITH {V.SQL_LINES}, {_RQ3} SELECT ap, CASE WHEN raw IS NULL THEN 'undefined' WHEN raw > 1 THEN 'out of range' ELSE 'estimable' END AS status, count(*) AS n FROM q GROUP BY 1, 2""")
def stat_rq3_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.status_counts(C.corrected(V.lines(spark, sf_dir), floor=10))


@query(f"""WITH {V.SQL_CONVERSATIONS}, {_TURNS}, {_rates_sql('t', _POINT.replace('c_line', 't'))}
    SELECT detector, genre, round(quantile_cont(rse + rsp - 1, 0.025), 7) AS j_lo, round(quantile_cont(rse + rsp - 1, 0.975), 7) AS j_hi, quantile_cont(rse + rsp - 1, 0.025) > 0 AS informative FROM rates GROUP BY 1, 2""")
def stat_rq3_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds_to(C.interval(_turns(spark, sf_dir)))


@query(f"""WITH {V.SQL_LINES} SELECT a.detector, a.genre, round(b.auroc - a.auroc, 7) AS shift FROM {_auroc_sql('detector, genre')} a JOIN {_auroc_sql('detector, genre', neg=chr(34) + 'set' + chr(34) + ' = ' + chr(39) + 'N3' + chr(39))} b ON a.detector = b.detector AND a.genre = b.genre""")
def stat_temporal_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.lines(spark, sf_dir).withColumn("set", F.when(F.col("set") == "N3", "N2").otherwise(F.col("set")))
    return _rounded(M.temporal_shift(M.metrics(lines, replicates=1)), 7)


@query(f"""WITH {V.SQL_LINES}, o AS (SELECT * FROM {_POINT}), m AS (SELECT detector, genre, max(score) AS score FROM c_line WHERE agent = 'F' GROUP BY 1, 2) SELECT detector, genre, round(score, 6) AS score, round(threshold, 6) AS threshold, score >= threshold AS flagged FROM m JOIN o USING (detector, genre)""")
def stat_worked_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.lines(spark, sf_dir)
    found = M.worked_example(lines.withColumn("first", -F.col("score")), M.metrics(lines, replicates=1), "first", F.col("agent") == "F")
    return _rounded(found, 6)


@query(f"""WITH {V.SQL_LINES}, o AS (SELECT * FROM {_POINT}), f AS (SELECT detector, genre, avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) AS b FROM c_line JOIN o USING (detector, genre) WHERE "set" = 'N3' GROUP BY 1, 2)
    SELECT detector, round(avg(fpr), 9) AS human, round(avg(b), 9) AS bots, round(min(b), 9) AS least, round(max(b), 9) AS most FROM o JOIN f USING (detector, genre) GROUP BY 1""")
def stat_figure_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.figure_means(M.automation_gap(V.lines(spark, sf_dir), floor=10)))


@query(f"""WITH {V.SQL_DOCUMENTS} SELECT genre, n, scored, missing_pct FROM (SELECT genre, count(*) AS n, count_if("set" <> 'N2') AS scored, round(100.0 * count_if("set" = 'N2') / count(*), 2) AS missing_pct FROM c_doc GROUP BY 1) WHERE missing_pct > 0 AND missing_pct < 100""")
def stat_coverage_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.documents(spark, sf_dir).withColumn("score", F.when(F.col("set") != "N2", 1.0))
    return partially_scored(coverage(docs, ["genre"]))


@query(f"WITH {V.SQL_LINES} SELECT detector, " + ", ".join(f"round(avg(CASE WHEN genre = '{g}' THEN auroc END), 9) AS g{i}" for i, g in enumerate(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])) + f" FROM {_auroc_sql('detector, genre')} GROUP BY 1")
def report_by_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calibrant.plans.report import by_genre

    genres = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    counts = S.score_counts(V.lines(spark, sf_dir), M.CELL, S.is_positive(), S.is_matched())
    table_ = by_genre(S.auroc(counts, M.CELL), "auroc", genres)
    return _rounded(table_.select("detector", *[F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(genres)]))
