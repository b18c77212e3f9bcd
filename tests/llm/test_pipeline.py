"""The pipeline's stages against brute force, on documents planted for each."""

import random

import corpus_pipeline as P
import pytest

from calibrant.llm import decontaminate

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good documents with copies, a shared line and benchmark passages, and poor ones."""
    draw = random.Random(0)

    def text(n=160):
        return ". ".join(" ".join(f"{draw.choice('bdfgklmnprst')}{draw.choice('aeiou')}{draw.randrange(500)}" for _ in range(n // 8)) for _ in range(8))

    rows, labels = [], []
    for i in range(60):
        rows.append((i, text(), "en", f"src{i % 20}"))
        labels.append((i, 1, 0))
    for i in range(60, 90):
        rows.append((i, "\n".join("BUY!! NOW$$$ FREE### CLICK*** HERE%%% " + " ".join(f"X{draw.randrange(9999)}!!" for _ in range(20)) for _ in range(4)), "en", "src1"))
        labels.append((i, 0, 0))
    rows += [(100 + i, rows[i][1], "en", "src2") for i in range(5)]
    rows += [(110 + i, rows[10 + i][1].replace(rows[10 + i][1].split()[40], "edited"), "en", "src2") for i in range(5)]
    rows += [(120 + i, f"{text()}\nthe shared footer of many sites", "en", f"src{i}") for i in range(15)]
    rows += [(140, f"{text()} {PASSAGE} {text()}", "en", "src3"), (141, PASSAGE, "en", "src3"), (142, None, "en", "src4"), (143, "", "en", "src4"), (0, rows[0][1], "en", "src0")]
    out = tmp_path_factory.mktemp("fixture")
    docs = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    after = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, folder)
        after[name] = docs.collect()
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
            docs = spark.createDataFrame(after[name], docs.schema)
    good = {r.doc_id for r in after["quality_rules"]}
    assert good >= {*range(60), *range(120, 135), 140} and not good & {*range(60, 90), 142, 143}
    lines = {r.doc_id: r for r in after["line_dedup"]}
    assert [i for i, r in lines.items() if "shared footer" in (r.text or "")] == [120]
    assert all(r.n_chars == len(r.text) for r in lines.values())
    unique = sorted(r.doc_id for r in after["simhash_near_dedup"])
    assert len(unique) == len(set(unique)) and {*range(60), *range(120, 135), 140} <= set(unique) and not set(unique) & {*range(100, 105), *range(110, 115)}
    clean = {r.doc_id: r for r in after["decontamination"]}
    assert set(unique) - set(clean) <= {141} and 140 in clean
    automaton = decontaminate.SuffixAutomaton([("1", decontaminate.words_of(PASSAGE.encode()))])
    assert not any(automaton.hits(decontaminate.words_of(r.text.encode()))[0] for r in clean.values())
    assert {r.doc_id for r in after["sentencepiece"]} == set(clean) and all(r.n_tokens > 0 for r in after["sentencepiece"])
    run = P.run(spark, folder)
    assert sorted(r.doc_id for r in run.collect()) == sorted(clean)


def test_empty(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, folder).count() == 0
