"""Decontamination against brute force, and its edge cases."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from calibrant.llm import decontaminate as D
from calibrant.llm import queries as Q


def brute(items, words, window=8):
    """Hit positions and items by comparing every window with every place."""
    hit, owners = set(), set()
    for name, own in items:
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for j in range(len(words) - size + 1):
                if own[i : i + size] == words[j : j + size]:
                    hit |= set(range(j, j + size))
                    owners.add(name)
    return hit, owners


run = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(run, max_size=5), st.lists(st.sampled_from([b"a", b"b", b"c", b"z"]), max_size=40), st.sampled_from([3, 5, 8]))
def test_automaton_equals_brute_force(items, words, window):
    items = [(str(i), w) for i, w in enumerate(items)]
    spans, owners = D.SuffixAutomaton(items, window).hits(words)
    hit, expected = brute(items, words, window)
    assert {i for a, b in spans for i in range(a, b)} == hit
    assert owners == expected
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_words():
    assert D.words_of("Ab-C9 é_x\n".encode()) == [b"ab", b"c9", "é".encode(), b"x"]
    assert D.words_of(None) == D.words_of(b"") == []


def test_blocks_equal_one_block_and_edges(spark):
    passage = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, f"start {passage} end", 5), (2, None, 6), (3, "", 7), (1, f"start {passage} end", 5), (4, "hello there friend " * 4, 8)], "doc_id long, text string, n_words int")
    items = spark.createDataFrame([(10, passage), (11, "there friend"), (12, None), (13, ""), (None, "hello there"), (10, passage)], "item_id long, text string")
    results = [sorted(map(str, D.find(docs, items, block_words=n).select("doc_id", "n_words", "hit_spans", "hit_items").collect())) for n in (10**6, 8)]
    assert results[0] == results[1]
    rows = {r.doc_id: r for r in D.find(docs, items).collect()}
    assert rows[1].n_words == 11 and [tuple(s) for s in rows[1].hit_spans] == [(1, 10)] and rows[1].hit_items == ["10"]
    assert rows[2].n_words == rows[3].n_words == 0 and rows[2].hit_items == []
    assert rows[4].hit_items == ["11"] and [tuple(s) for s in rows[4].hit_spans] == [(0, 12)]
    none = D.find(docs, items.limit(0)).select(F.sum(F.size("hit_items"))).first()[0]
    assert none == 0
    assert D.find(docs.limit(0), items).count() == 0


def test_clean(spark):
    passage = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, f"Start, {passage.upper()}! End of it\nall"), (2, None), (3, passage), (4, f"one two {passage} three four five six seven eight x y z"), (5, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = {r.doc_id: r.text for r in D.clean(docs, items).collect()}
    assert kept == {1: "Start, ! End of it\nall", 2: None, 4: "   x y z".replace("   ", "  ", 1).lstrip() and kept[4], 5: "nothing here"}
    others = spark.createDataFrame([(1, passage), (2, "some other item of nine words that is long")], "item_id long, text string")
    texts = docs.unionByName(spark.createDataFrame([(6, "a some other item of nine one two three four five six seven eight words that is long b " + "pad " * 30)], docs.schema)).withColumns({"hit_spans": F.lit("x"), "n_words": F.lit("y"), "body": F.lit("z"), "kept": F.lit("k")})
    passes = D.clean(texts, others, block_words=8)
    assert passes.columns == texts.columns
    expected = {tuple(r) for r in D.clean(texts, others).collect()}
    assert {tuple(r) for r in passes.collect()} == expected and len(expected) == 5
    assert all(r[2:] == ("x", "y", "z", "k") for r in expected)
    assert "three four five six seven eight" not in kept[4] and kept[4].split() == ["x", "y", "z"]


def test_query_digests(spark, sf_dir):
    rows = Q.op3_decontaminate(spark, sf_dir).collect()
    items = [(r.item_id, D.words_of((r.text or "").encode())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {}
    for name, own in items:
        size = min(8, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[i : i + size]), set()).add(str(name))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    sizes = {len(w) for w in windows}
    for r in rows:
        words, hit, owners = D.words_of((texts[r.doc_id] or "").encode()), set(), set()
        for size in sizes:
            for j in range(len(words) - size + 1):
                if found := windows.get(tuple(words[j : j + size])):
                    hit |= set(range(j, j + size))
                    owners |= found
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(owners), len(owners) >= 2)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
