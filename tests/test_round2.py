"""Odd inputs of round 2: every query equals its SQL on them."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_oracles import plain


def same(spark, folder, name, tables):
    """The query's rows equal the SQL's on these Parquet tables; returns them."""
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = connection.execute(entry.oracle_sql()[name])
    places = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert rows == sorted(str([plain(r[i]) for i in places]) for r in cursor.fetchall())
    return rows


def test_years_past_9999(spark, tmp_path):
    rows = spark.createDataFrame([(i,) for i in (0, 2534023, 2534024, 5_999_999, -621_355, -621_400, -662_000, None)], "event_id long")
    events = rows.withColumn("ts", F.lit("2024-01-11 23:59:59").cast("timestamp_ntz"))
    assert len(same(spark, tmp_path, "date_epoch", {"events": events})) == 8


ODD = [
    "xé as an ai", "éas an ai", "hope thiſ helps!", "certainly!", "here is anſ", "overall,é", "a\n**Head**\x0b\nb", "## \x85", " - [x] a", "\x0b- **a** –", "docſ: y", "é, b and c",
    "a, bſ and Ké", "written\x0bby claude", "uſed copilot", "with groK", "by claude", "from llamaé", "", None, "- a b\n" * 20_000,
]


def odd_tables(spark):
    docs = [(i, t, lang) for i, (t, lang) in enumerate((t, lang) for t in ODD for lang in ("en", "fr", None))]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "<a>\u0085as an aié"), (2, None)], "page_id long, html string")
    return {"documents": docs, "labels": labels, "pages": pages}


def test_heuristics_as_sql(spark, tmp_path):
    rows = same(spark, tmp_path, "det_heuristics", odd_tables(spark))
    assert len(rows) == 3 * len(ODD) + 2 and len({r.split(",")[1] for r in rows}) > 2


def test_heuristics_explain_as_sql(spark, tmp_path):
    assert len(same(spark, tmp_path, "det_heuristics_explain", odd_tables(spark))) == 3 * len(ODD) + 2


@pytest.mark.parametrize("name", ["det_registry_run", "det_selfadmission"])
def test_registry_run_as_sql(spark, tmp_path, name):
    assert len(same(spark, tmp_path, name, odd_tables(spark))) == 3 * len(ODD) * (2 if name == "det_registry_run" else 1)


def test_cache_miss_as_sql(spark, tmp_path):
    assert len(same(spark, tmp_path, "judge_cache_miss", odd_tables(spark))) == len(ODD)


@pytest.mark.parametrize("name", ["lm_binoculars", "lm_fast_curvature"])
def test_likelihood_by_blocks(spark, tmp_path, name):
    """Words as SQL cuts them; several files, so several blocks; no row per word in the plan."""
    texts = ["a b\x0bc a b a", "ΑΣ İ a b", None, "", " \t", "a", "b a b a b\rc"] + [f"a w{i % 7} b w{i % 3} a" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert len(same(spark, tmp_path, name, {"documents": docs})) == len(texts) - 3
    assert "Generate" not in entry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_boosting_in_few_tasks(spark, tmp_path, monkeypatch):
    """Each tree's stages read a checkpoint of as few tasks as the texts need, not the whole plan."""
    from calibrant.detectors import supervised

    seen = []

    def fit(self, learn):
        seen.append((learn.rdd.getNumPartitions(), learn._jdf.queryExecution().executedPlan().toString().count("Window")))
        raise InterruptedError

    monkeypatch.setattr(supervised.GBTClassifier, "fit", fit)
    rows = [(i, f"text {i} " * (i % 5), "P" if i % 2 else "N1", True, "g", f"r{i % 20}") for i in range(200)]
    corpus = spark.createDataFrame(rows, "row_id long, text string, set string, matched boolean, genre string, repo string").repartition(4)
    with pytest.raises(InterruptedError):
        supervised.out_of_fold(corpus, floor=20)
    assert seen and set(seen) == {(1, 0)}


def test_perturbed_by_blocks(spark, tmp_path, monkeypatch):
    """Runs of white space of every kind: as by joins, but without a row per pair; and by joins if there are too many different runs."""
    import random

    from calibrant.detectors import lm, spaced

    rng = random.Random(2)
    bits = ["a", "b", "É", "ΑΣ", " ", " ", "  ", "\n", "\n", "\t", "c ", "d  e", "\x0b", " \n ", "İ "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(120)] + [None, "", " ", "\n\n", "   a", "abc", "z\n", " \t "]
    docs = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").repartition(3)
    found, joined = ({r.row_id: (r.base, r.perturbed) for r in f(docs, 7).collect()} for f in (spaced.log_ranks, lm.joined_log_ranks))
    assert found.keys() == joined.keys() and len(found) == len(texts) and found[len(texts) - 7] == (None, None)
    assert all(found[k] == pytest.approx(joined[k], rel=1e-9) for k in found if None not in found[k])
    assert [k for k in found if None in found[k]] == [k for k in found if None in joined[k]]
    docs.withColumnRenamed("row_id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    plan = entry.queries()["lm_npr"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    scores = {r.row_id: r.score for r in lm.perturbed_npr(docs, 7).collect()}
    monkeypatch.setattr(spaced, "RUNS", 3)
    assert spaced.log_ranks(docs, 7) is None
    assert {r.row_id: r.score for r in lm.perturbed_npr(docs, 7).collect()} == pytest.approx(scores, nan_ok=True)


def test_places_as_steps(spark):
    """What is held for a text is less than three bytes a word, and all sums but the ranks' need no ranks sent."""
    import numpy as np

    from calibrant.detectors import blocks, lm

    rng = np.random.default_rng(3)
    lengths = np.append(rng.integers(0, 900, 300), [0, 1, 0])
    places = rng.integers(0, 90_000, lengths.sum())
    kept = blocks.packed(*blocks.stepped(lengths, places))
    sizes, found = blocks.unstepped(*blocks.unpacked(kept))
    low = np.cumsum(lengths) - lengths
    assert sizes.tolist() == lengths.tolist() and len(kept) < 1.6 * len(places)
    assert found.tolist() == [x for a, n in zip(low, lengths, strict=True) for x in sorted(places[a : a + n].tolist())]
    docs = spark.createDataFrame([(i, f"a w{i % 7} b w{i % 3} a b a") for i in range(40)], "row_id long, text string").repartition(3)
    whole = {r.row_id: r.asDict() for r in lm.token_stats(lm.tokens(docs)).collect()}
    for ranks in (True, False):
        rows = [r.asDict() for r in lm.text_stats(docs, ranks=ranks).collect()]
        assert len(rows) == 40 and all(("log_rank" in r) == ranks and r == pytest.approx({k: whole[r["row_id"]][k] for k in r}) for r in rows)
