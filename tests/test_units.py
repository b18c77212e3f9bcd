"""Hand-made rows, property tests and plans of the engine."""

import hashlib
import os
import re
import subprocess

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from calibrant.detectors import judge, registry, rules
from calibrant.functions import stats as S
from calibrant.functions import text as X
from calibrant.functions.structure import edges
from calibrant.operators import relational as R
from calibrant.operators import sampling
from calibrant.plans import correction, figures, report, validity
from calibrant.sources import clones, history, sinks, tables
from calibrant.streaming import resume


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def brute_auroc(pos, neg):
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_point(pos, neg, target=0.05):
    best = None
    for t in sorted(set(pos + neg), reverse=True):
        fpr, recall = sum(n >= t for n in neg) / len(neg), sum(p >= t for p in pos) / len(pos)
        if best is None or fpr <= target:
            best = (t, fpr, recall)
        if fpr > target:
            break
    return best


values = st.lists(st.integers(0, 6).map(float), min_size=1, max_size=25)


@settings(max_examples=6, deadline=None)
@given(values, values)
def test_two_samples(spark, pos, neg):
    rows = [("P", p) for p in pos] + [("N1", n) for n in neg] + [("P", None)]
    df = spark.createDataFrame([(1, s, v) for s, v in rows], "k int, set string, score double")
    counts = S.score_counts(df, ["k"], F.col("set") == "P", F.col("set") == "N1").cache()
    a = S.auroc(counts, ["k"]).first().auroc
    assert abs(a - brute_auroc(pos, neg)) < 1e-12
    swapped = S.auroc(counts.select("k", "score", F.col("p").alias("n"), F.col("n").alias("p")), ["k"]).first().auroc
    assert abs(a + swapped - 1) < 1e-12
    o = S.operating_point(counts, ["k"]).first()
    assert (o.threshold, o.fpr, o.recall) == pytest.approx(brute_point(pos, neg))


def test_edge_cells(spark):
    df = spark.createDataFrame([("a", "P", 1.0), ("a", "N1", 1.0), ("b", "P", 2.0), ("b", "N1", 1.0), ("c", "P", 1.0)], "k string, set string, score double")
    counts = S.score_counts(df, ["k"], F.col("set") == "P", F.col("set") == "N1")
    assert {r.k: r.auroc for r in S.auroc(counts, ["k"]).collect()} == {"a": 0.5, "b": 1.0, "c": None}
    assert {r.k for r in S.operating_point(counts, ["k"]).collect()} == {"a", "b"}


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_prefix_sums(spark, parts):
    rows = [(k, float(v), (v * 7 + k) % 5) for k in (1, 2) for v in range(40)]
    df = spark.createDataFrame(rows, "k int, v double, n long")
    for down in (False, True):
        for r in R.prefix_sums(df, ["k"], "v", ["n"], down, parts).collect():
            assert r.n_before == sum(n for k, v, n in rows if k == r.k and (v > r.v if down else v < r.v))


def test_correction(spark):
    cases = [(0.20, 0.927, 0.95, 0.171, "estimable"), (0.2, 0.024, 0.95, None, "undefined"), (0.40, 0.10, 0.95, 1.0, "out of range"), (0.02, 0.5, 0.95, 0.0, "estimable")]
    df = spark.createDataFrame([c[:3] for c in cases], "ap double, se double, sp double")
    raw = S.raw_prevalence(F.col("ap"), F.col("se"), F.col("sp"))
    rows = df.select(S.rogan_gladen(F.col("ap"), F.col("se"), F.col("sp")).alias("p"), S.correction_status(raw).alias("s")).collect()
    assert [(None if r.p is None else round(r.p, 3), r.s) for r in rows] == [c[3:] for c in cases]
    prevalence, se, sp = 0.3, 0.8, 0.9
    ap = prevalence * se + (1 - prevalence) * (1 - sp)
    assert abs(spark.range(1).select(S.rogan_gladen(F.lit(ap), F.lit(se), F.lit(sp)).alias("p")).first().p - prevalence) < 1e-12


def test_calibration_bins(spark):
    scores = [0.0, 0.1, 0.1000001, 0.3, 0.30000000000000004, 1.0]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    assert [r.b for r in df.select(S.calibration_bin(F.col("s")).alias("b")).collect()] == [1, 1, 2, 3, 3, 10]
    assert edges(10)[3] == 0.30000000000000004


def test_rules(spark):
    text = "fix: improve error handling in WebSockets"
    assert one(spark, text, lambda c: F.round(rules.heuristics(c), 3)) == 0.077
    assert one(spark, text, rules.self_admission) == 0.0
    cases = {"assistant_voice": "as an AI", "offer_of_help": "Hope this helps", "certainly": "Certainly! ok", "here_is": "Here's the thing", "summary_offer": "To summarize, it", "emoji": "x 🚀", "bold_headers": "a\n**Head**:\nb", "markdown_heading": "a\n## b", "bullet_block": "- a\n- b\n- c\n", "checkbox_list": " - [x] a", "bold_label_line": "- **a** – b", "conventional_commit": "feat(x)!: y", "triadic_list": "é1, b, AND c"}
    for name, sample in cases.items():
        found = one(spark, sample, rules.explain).asDict()
        assert found[name], name
        flags = {"i": re.I, "m": re.M}
        for rule, f, pattern in rules.RULES:
            plain = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), pattern)
            assert found[rule] == bool(re.search(plain, sample, sum(flags[c] for c in f if c in flags))), (rule, sample)
    assert one(spark, "written by\n ChatGPT", rules.self_admission) == 1.0 and one(spark, "Created  by me", rules.attribution)


def test_strings(spark):
    assert one(spark, "\u00a0 x \u2003\x1c", X.strip) == "x"
    assert one(spark, "a\r\nb\x0bc\u2028d\n", X.split_lines) == ["a", "b", "c", "d"]
    assert one(spark, "", X.split_lines) == []
    assert one(spark, "75 of 100", X.first_score) == 0.75 and one(spark, "999", X.first_score) == 1.0 and one(spark, "no", X.first_score) is None
    assert one(spark, "a[12]/issue3/b", X.generic_path) == "a[]/issueNNN/b"
    assert one(spark, "llm_judge p5", X.macro_name) == "LlmJudgePFive"
    assert one(spark, "Test Plan: x", X.has_boilerplate) and not one(spark, None, X.has_boilerplate)
    assert one(spark, "https://w3id.org/x#y", lambda c: X.short_iri(c, {"x": "https://w3id.org/x#"})) == "x:y"


def test_registry(spark):
    registry.load_adapters(["calibrant.detectors.rules", "calibrant.detectors.judge", "calibrant.detectors.absent"])
    assert registry.available()["absent"].startswith("unavailable")
    corpus = spark.createDataFrame([(1, "a", "x, y, and z", "P"), (2, "b", None, "N1")], "row_id long, source_id string, text string, set string")
    written = []
    log = registry.sweep(corpus, ["heuristics", "nothing", "selfadmission"], lambda df: written.append(df.collect()))
    assert [bool(x["error"]) for x in log] == [False, True, False] and len(written) == 2
    assert registry.relative("/a/b/c", "/a") == "b/c" and registry.relative("/x", "/a") == "/x"


def test_judge_cache(spark):
    texts = spark.createDataFrame([(1, "say 80"), (2, "refuse"), (3, "say 80")], "row_id long, text string")
    cache = spark.createDataFrame([], "key string, shard string, raw string")
    scored, fresh = judge.judged(texts, cache, lambda t: "80" if "say 80" in t and t.startswith("How likely") else "no", "m", most_missing=0.5)
    assert fresh.count() == 2
    assert {r.row_id: r.score for r in scored.collect()} == {1: 0.8, 2: None, 3: 0.8}
    again, none = judge.judged(texts, fresh, lambda t: 1 / 0, "m", most_missing=0.5)
    assert none.count() == 0 and again.where("score = 0.8").count() == 2
    assert not judge.enough_answers(scored)
    with pytest.raises(ValueError, match="answers are missing"):
        judge.judged(texts, cache, lambda t: "no", "m")


def test_collector():
    clock = [0.0]
    limit = history.RateLimit(lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    answers = iter([(429, None, {"retry-after": 5}), (200, [{"created_at": "2020"}, {"created_at": "2021"}], {}), (500, None, {}), (200, [{"created_at": "2022"}, {"created_at": "2023"}], {})])
    got = list(history.paged(lambda path, page: next(answers), "/x", "2023", limit, size=2))
    assert [x["created_at"] for x in got] == ["2020", "2021", "2022"] and clock[0] >= 5
    assert history.fetch(lambda path, page: (404, None, {}), "/x", 1, limit) == (None, "http 404")
    with pytest.raises(history.FailedPage, match="http 404"):
        list(history.paged(lambda path, page: (404, None, {}), "/x", "2023", limit))


def test_collection_keeps_failures(spark):
    answers = {("a", 1): (200, [{"created_at": "2020"}] * 100, {}), ("a", 2): (404, None, {}), ("b", 1): (200, [{"created_at": "2021"}], {})}
    repos = spark.createDataFrame([("a",), ("b",), ("c",), ("b",)], "repo string")
    rows = history.collect(repos, lambda path, page: answers.get((path, page), (200, [], {})), "2023").collect()
    assert sorted((r.repo, r.error) for r in rows if r.item is None) == [("a", "page 2: http 404")]
    assert sorted(r.repo for r in rows if r.item) == ["a"] * 100 + ["b"]


def test_patches_by_file(spark):
    raw = "+before\r\ndiff --git a/x b/x\r\n@@ 1\n+one\n+++ b/x\x85 kept\ndiff --git a/e b/e\nindex\ndiff --git a/y b/z w\n-two"
    rows = spark.createDataFrame([(1, raw), (2, None), (3, ""), (4, "no diff")], "k int, raw string").select("k", history.patches(F.col("raw")).alias("p")).collect()
    found = {r.k: r.p and [tuple(x) for x in r.p] for r in rows}
    assert found == {1: [("x", "@@ 1\n+one\n kept"), ("z w", "-two")], 2: None, 3: [], 4: []}
    shows = spark.createDataFrame([("r", "__COMMIT__".join(["", *[f"s{i}\ndiff --git a/f b/f\n+line number {i}" for i in range(50)]]))], "repo string, raw string")
    assert history.diffs(shows).select("sha").distinct().count() == 50


def test_generations(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(1, k), (10 + k, k)], "id int, version int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = resume.files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, per_batch=1)
    resume.land(source, str(tmp_path / "log"), resume.upsert_into(spark, str(tmp_path / "table"), ["id"], "version"))
    assert (tmp_path / "table" / "2").exists()
    assert sorted(map(tuple, resume.latest(spark, str(tmp_path / "table")).select("id", "version").collect())) == [(1, 2), (10, 0), (11, 1), (12, 2)]


def test_sources(spark, tmp_path):
    schema = spark.createDataFrame([], "a long, b string").schema
    assert tables.optional(spark, str(tmp_path / "none"), schema).count() == 0
    spark.range(3).withColumnRenamed("id", "a").write.parquet(str(tmp_path / "t"))
    assert tables.optional(spark, str(tmp_path / "t"), schema).where("b IS NULL").count() == 3
    assert tables.env_settings("# c\nexport A='1'\nB=2\nbad\n", {"B": "3"}) == {"A": "1", "B": "3"}
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert tables.checksums(spark, str(tmp_path / "f.bin")).first().sha256.startswith("ba7816bf")
    with pytest.raises(ValueError, match="unknown tables: y"):
        tables.known_tables(spark, str(tmp_path), ["y"], ["x"])
    (tmp_path / "q.sql").write_text("-- what it says\nSELECT 1")
    assert tables.query_files(str(tmp_path)) == {"q": ("what it says", "SELECT 1")}
    scores = spark.createDataFrame([(1, "a", float("nan")), (2, "b", 0.5)], "row_id long, detector string, score double")
    for part in ("a", "b"):
        sinks.write_scores(scores.where(F.col("detector") == part), str(tmp_path / "scores"))
    assert tables.scores(spark, str(tmp_path / "scores")).where("score IS NULL").count() == 1
    assert '"rows"' in sinks.manifest(scores.groupBy("detector").count())


def test_sampling(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else "y", i % 2, f"r{i % 11}" if i % 5 else None) for i in range(300)], "row_id long, genre string, y int, repo string")
    folds = sampling.grouped_folds(df, "y", "repo", "row_id").collect()
    owner = {}
    for r in folds:
        assert r.repo is None or owner.setdefault(r.repo, r.fold) == r.fold
    assert {r.fold for r in folds} <= set(range(5)) and len(folds) == 300
    lone = [(r.y, r.fold) for r in sampling.grouped_folds(df.withColumn("repo", F.lit("")), "y", "repo", "row_id").collect()]
    assert all(lone.count((y, k)) == 30 for y in (0, 1) for k in range(5))
    counts = df.groupBy("genre").agg(F.count("*").alias("n"), F.lit(1).alias("one"), F.lit(0).alias("none"))
    drawn = sampling.bootstrap_counts(counts, ["genre"], ["n", "one", "none"], 2000).groupBy("genre").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("n", "one", "none") for f in (F.avg, F.var_samp)])
    for r in drawn.collect():
        size = {"x": 200, "y": 100}[r.genre]
        assert abs(r.avg_n - size) < 1.5 and 0.85 < r.var_samp_n / size < 1.15 and r.avg_none == 0
        assert abs(r.avg_one - 1) < 0.08 and 0.85 < r.var_samp_one < 1.15
    assert sampling.draw(df, 5, "row_id").collect() == sampling.draw(df.repartition(7), 5, "row_id").collect()


def test_lowest_hashes(spark):
    df = spark.createDataFrame([(i, "xyz"[i % 3], "k") for i in range(3000)], "row_id long, genre string, _n string")
    wanted = spark.createDataFrame([("x", 10), ("y", 5000), ("z", 0)], "genre string, wanted long")
    found = sampling.lowest(df, ["genre"], wanted, "wanted", "row_id")
    order = lambda i: hashlib.md5(f"7|{i}".encode()).hexdigest()
    expected = sorted(range(0, 3000, 3), key=order)[:10] + list(range(1, 3000, 3))
    assert sorted(r.row_id for r in found.collect()) == sorted(expected) and found.columns == df.columns
    # no whole key is ordered: the only windows are over counts of hash steps and over the rows at the edge
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1


def test_intervals_match_row_bootstrap(spark):
    draw = np.random.default_rng(5)
    sides = {"P": draw.normal(0.4, 1, 180), "N1": draw.normal(0, 1, 260)}
    df = spark.createDataFrame([("d", "g", s, True, float(x)) for s, xs in sides.items() for x in xs], "detector string, genre string, set string, matched boolean, score double")
    got = validity.bootstrap_interval(df).first()

    def area(p, n):
        return float((p[:, None] > n[None]).mean() + (p[:, None] == n[None]).mean() / 2)

    again = [area(draw.choice(sides["P"], 180), draw.choice(sides["N1"], 260)) for _ in range(1500)]
    assert abs(got.auroc - area(sides["P"], sides["N1"])) < 1e-12
    assert abs(got.ci_lo - np.percentile(again, 2.5)) < 0.012 and abs(got.ci_hi - np.percentile(again, 97.5)) < 0.012
    j = correction.interval(df).first()
    assert j.j_lo < j.j_hi
    cut = np.sort(sides["N1"])[::-1]
    threshold = min(x for x in np.concatenate(list(sides.values())) if (cut >= x).mean() <= 0.05)
    js = [(draw.choice(sides["P"], 180) >= threshold).mean() - (draw.choice(sides["N1"], 260) >= threshold).mean() for _ in range(1500)]
    assert abs(j.j_lo - np.percentile(js, 2.5)) < 0.02 and abs(j.j_hi - np.percentile(js, 97.5)) < 0.02


def test_report(spark):
    metric = spark.createDataFrame([("a", "g", 0.5), ("a", "h", 0.75)], "detector string, genre string, auroc double")
    assert "0.750" in report.latex_table(metric, "auroc", ["g", "h"], "c", "l")
    assert {r.value for r in report.macros(metric, "auroc").collect()} == {r"\newcommand{\AGAuroc}{0.500}", r"\newcommand{\AHAuroc}{0.750}"}
    assert {r.genre: r.shown for r in report.highlighted(metric, "auroc").collect()} == {"g": "0.500", "h": r"\textbf{0.750}"}


def test_triples_escape(spark):
    rows = [("s", "p", 'say "hi" \\ there', "string"), ("s", "p", "o", "iri"), ("s", "p", "3", "integer")]
    lines = sinks.n_triples(spark.createDataFrame(rows, "s string, p string, o string, o_type string"))
    assert r'"say \"hi\" \\ there"' in {r.value.split("> ", 2)[2].removesuffix(" .") for r in lines.collect()}
    assert {r.o_type for r in tables.triples(lines).collect()} == {"string", "iri", "integer"}


@pytest.mark.parametrize("name", ["det_heuristics", "det_features", "stat_auroc", "kg_q1_entailed", "smp_match_lengths"])
def test_native_plans(spark, sf_dir, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_validity_floors(spark):
    rows = [("d", "g", s, True, float(i % 7), i, "a", None) for i, s in enumerate(["P", "N1", "N3"] * 40)]
    df = spark.createDataFrame(rows, "detector string, genre string, set string, matched boolean, score double, n_chars long, agent string, ext string")
    assert validity.by_length(df).count() == 0 and validity.by_length(df, cell_floor=20, bin_floor=5).count() == 5
    assert validity.automation_gap(df).count() == 0 and validity.automation_gap(df, floor=10).count() == 1
    assert correction.corrected(df).count() == 0 and correction.status_counts(correction.corrected(df, floor=10)).agg(F.sum("n")).first()[0] == 5


def test_perturbed_npr(spark):
    import math
    from collections import Counter, defaultdict

    from calibrant.detectors import lm

    texts = {1: "a b a c a b\na d b", 2: "b a b\na b c d a", 3: "", 4: None, 5: "a b a b a c"}
    corpus = spark.createDataFrame(list(texts.items()), "row_id long, text string")

    def pairs(text):
        pieces = re.findall(r"\s+|\S+", (text or "").lower())
        return list(zip(["", *pieces], pieces, strict=False))

    counts = defaultdict(Counter)
    for t in texts.values():
        for a, b in pairs(t):
            counts[a][b] += 1

    def mean(text):
        own = pairs(text)
        return sum(math.log(1 + sum(n > counts[a][b] for n in counts[a].values())) for a, b in own) / max(1, len(own))

    copied = defaultdict(list)
    for r in lm.perturbations(corpus, 6).collect():
        copied[r.row_id].append(mean(r.text))
    got = {r.row_id: r.score for r in lm.perturbed_npr(corpus, 6).collect()}
    assert got.keys() == texts.keys() and got[3] is None and got[4] is None
    for i in (1, 2, 5):
        assert len(copied[i]) == 6 and got[i] == pytest.approx(sum(copied[i]) / 6 / mean(texts[i])) and got[i] != pytest.approx(1)


def test_clones(spark, tmp_path):
    def git(*args, **dates):
        names = {"GIT_AUTHOR_NAME": "A B", "GIT_AUTHOR_EMAIL": "a@b.c", "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@d.e", "HOME": str(tmp_path)}
        subprocess.run(["git", "-C", str(tmp_path / "r"), *args], check=True, capture_output=True, env={**os.environ, **names, **dates})

    for name in ("r", "empty"):
        subprocess.run(["git", "init", "--quiet", str(tmp_path / name)], check=True)
    git("config", "uploadpack.allowFilter", "true")
    git("config", "uploadpack.allowAnySHA1InWant", "true")
    for k, day in enumerate(("2020-01-01", "2021-01-01", "2023-01-01")):
        (tmp_path / "r" / "f.py").write_text("".join(f"line number {i}\n" for i in range(k + 2)))
        git("add", "f.py")
        git("commit", "--quiet", "-m", f"Change {k}\n\nWhy it is so: é \x01", GIT_AUTHOR_DATE=f"{day}T00:00:00Z", GIT_COMMITTER_DATE=f"{day}T00:00:00Z")
    repos = spark.createDataFrame([("r",), ("r",), ("empty",), ("absent",), (None,)], "repo string")
    address = lambda repo: f"file://{tmp_path}/{repo}"
    logs = clones.logs(repos, address, "2022-01-01", 10, callers=2, tries=2).cache()
    assert [(r.repo, r.raw, "clone: " in r.error) for r in logs.where("error IS NOT NULL").collect()] == [("absent", None, True)]
    found = history.commits(logs.where("raw IS NOT NULL")).orderBy("committed_at").collect()
    assert [(r.repo, r.author, r.text.split("\n")[0], r.is_merge) for r in found] == [("r", "A B <a@b.c>", f"Change {k}", False) for k in (0, 1)]
    assert clones.logs(repos.where("repo = 'r'"), address, "2022-01-01", 1).count() == 1
    wanted = spark.createDataFrame([(r.repo, r.sha) for r in found] + [("r", "--output=x"), ("r", "0" * 40)], "repo string, sha string")
    bad = clones.shows(wanted, address).where("error IS NOT NULL")
    assert bad.count() == 1
    raw = clones.shows(wanted.where(F.col("sha") != "0" * 40), address)
    assert {(r.sha, r.filename, r.text.split("\n")[-1]) for r in history.diffs(raw.where("raw IS NOT NULL")).collect()} == {(found[0].sha, "f.py", "+line number 1"), (found[1].sha, "f.py", "+line number 2")}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=9), max_size=12), st.integers(1, 7), st.integers(1, 12), st.booleans())
def test_clone_rows(parts, block, size, ends):
    text = "".join(p + "|" if ends else "|" + p for p in parts)
    rows = list(clones._rows((text[i : i + block] for i in range(0, len(text), block)), "|", ends, size))
    assert "".join(rows) == text and all(r.endswith("|") if ends else r.startswith("|") for r in rows)


def test_figures(spark, tmp_path):
    cells = [("a(b)", "g", 0.5), ("a(b)", "h", 0.75), ("ü", "g", 0.9), ("none", "g", None), ("nan", "g", float("nan")), ("far", "g", 7.0)]
    metric = spark.createDataFrame(cells, "detector string, genre string, auroc double")
    assert {tuple(r) for r in figures.ranges(metric, "auroc").collect()} == {("a(b)", 0.5, 0.75, 0.625), ("ü", 0.9, 0.9, 0.9), ("far", 7.0, 7.0, 7.0)}
    assert figures.dot_plot(metric, "auroc", str(tmp_path / "dots.pdf")) == 3
    means = spark.createDataFrame([("a", 0.1, 0.4), ("b", None, 0.2), ("c", 0.3, None)], "detector string, human double, bots double")
    assert figures.paired_bars(means, "human", "bots", str(tmp_path / "bars.pdf")) == 3
    assert figures.dot_plot(metric.where("false"), "auroc", str(tmp_path / "none.pdf")) == figures.paired_bars(means.where("false"), "human", "bots", str(tmp_path / "no_bars.pdf")) == 0
    dots, bars = (tmp_path / "dots.pdf").read_bytes(), (tmp_path / "bars.pdf").read_bytes()
    assert dots.count(b" 1 J 6 w ") == 4 and rb"(a\(b\))" in dots and bars.count(b" re f") == 4
    for pdf in (dots, bars):
        at = int(re.search(rb"startxref\n(\d+)", pdf)[1])
        starts = [int(x) for x in re.findall(rb"(\d{10}) 00000 n ", pdf[at:])]
        assert pdf[at : at + 4] == b"xref" and all(pdf[x:].startswith(b"%d 0 obj" % k) for k, x in enumerate(starts, 1))
