"""Token operators, quality models and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter as Bag

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from calibrant.llm import line_crf, quality_rules
from calibrant.llm import queries as Q
from calibrant.llm import sentencepiece_codec as C
from calibrant.llm import token_counts as N

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
odd_text = st.text(st.sampled_from(list(" \n\t\r▁abcé🙂<|>0'’s.")) | st.characters(codec="utf-8"), max_size=60)
#: Rows that every operator must take: null, empty, blank, long, odd, repeated, null id, clashing columns.
ROWS = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", "y"), (4, "word " * 30_000, "y"), (5, "a▁ b\x00<|endoftext|> é\r\n", None), (5, "a▁ b\x00<|endoftext|> é\r\n", None), (None, "same text here", "z"), (7, "n" * 100_000, "z")]
SCHEMA = "doc_id long, text string, n_tokens string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@settings(max_examples=400, deadline=None)
@given(odd_text)
def test_codec_equals_library(text):
    codec, library = C.codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    (ids,), (digits,) = codec.encode_digits([text])
    assert ids == library.encode(text) and digits == ",".join(map(str, ids)).encode()
    assert codec.decode(ids) == library.decode(ids)


def test_codec_forgets(monkeypatch):
    monkeypatch.setattr(C, "TABLE_WORDS", 3)
    codec = C.Codec(PIECES)
    texts = ["one two three four five", "six seven", "one two"]
    assert codec.encode(texts) == codec.library.encode(texts)
    assert [codec.encode([t])[0] for t in texts] == codec.library.encode(texts)


def test_codec_frames(rows, spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = C.digests(rows, PIECES).collect()
    assert len(found) == len(ROWS)
    expected = Bag()
    for i, t, _ in ROWS:
        ids = library.encode(t or "")
        expected[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())] += 1
    assert Bag((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == expected
    coded = C.encode(rows, PIECES)
    assert coded.columns == ["doc_id", "text", "n_tokens", "ids"]
    again = C.decode(coded.drop("text"), PIECES).collect()
    assert Bag((r.doc_id, r.text) for r in again) == Bag((i, library.decode(library.encode(t or ""))) for i, t, _ in ROWS)
    assert C.digests(rows.limit(0), PIECES).count() == 0
    kept = {r.doc_id: r.text for r in C.round_trip(rows, PIECES).collect()}
    assert kept[1] is None and kept[2] == ""


@settings(max_examples=400, deadline=None)
@given(odd_text)
def test_counts_equal_library(text):
    text = text.replace("<>", "<|endoftext|>")
    counter = N.counter(BYTES, N.HUGE, N.CHUNK, N.OVERLAP)
    assert counter.count([text]) == [len(counter.library.encode(text, add_special_tokens=False).ids)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "\n", "word", "é", "<|endoftext|>", "  ", "1", "'s", "!?", "🙂", "x" * 70, " " * 70]), max_size=60), st.integers(20, 90))
def test_splicing_equals_library(parts, chunk):
    text = "".join(parts)
    counter = N.Counter(BYTES, 0, chunk, 4)
    assert counter.spliced(text) == len(counter.library.encode(text, add_special_tokens=False).ids)


def test_splicing_widens():
    counter = N.Counter(BYTES, 0, 60, 4)
    text = "b" * 2000 + " tail of words" * 40
    assert counter.spliced(text) == len(counter.library.encode(text, add_special_tokens=False).ids)
    assert counter.widened > 0


def test_count_frames(rows):
    library = Tokenizer.from_file(BYTES)
    found = N.count_tokens(rows, BYTES).collect()
    expected = Bag()
    for i, t, _ in ROWS:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected[(i, len((t or "").encode()), n, n > 512)] += 1
    assert Bag((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found) == expected
    assert N.count_tokens(rows.limit(0), BYTES).count() == 0


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    runs = Bag(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(marked)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", " ", "\n", "\x0b", "#", "<", " ", "🙂"]), max_size=80).map(lambda x: " ".join(x) if len(x) % 2 else "".join(x)))
def test_statistics_equal_brute_force(text):
    assert quality_rules.statistics(text.encode()) == brute_statistics(text)


GOOD = "the quick brown fox jumps over a lazy dog and runs far away from here today"
BAD = "BUY!! NOW!! $$$ FREE### CLICK*** HERE%%% WIN&&& CASH!! BUY!! FAST$$$ MONEY### YES"


def labelled(n=120):
    draw = random.Random(3)
    rows = []
    for i in range(n):
        words = (GOOD if i % 3 else BAD).split()
        rows.append((i, "\n".join(" ".join(draw.sample(words, len(words))) for _ in range(3)), int(i % 3 > 0)))
    return rows


def test_quality_model(spark, rows):
    data = spark.createDataFrame(labelled(), "doc_id long, text string, quality int")
    model = quality_rules.train(data.drop("quality"), data.drop("text"))
    kept = {r.doc_id: r.kept for r in quality_rules.judge(data, model).collect()}
    assert all(kept[i] == bool(q) for i, _, q in labelled())
    judged = quality_rules.judge(rows, model).collect()
    assert len(judged) == len(ROWS) and not any(r.kept for r in judged if r.doc_id in (1, 2, 3))
    assert quality_rules.train(data.drop("quality"), data.drop("text").limit(0)) is None
    open_ = quality_rules.judge(data, None)
    assert all(r.kept != r.base_failed for r in open_.collect())
    clash = data.withColumnRenamed("quality", "kept")
    good = quality_rules.keep_good(clash, model)
    assert good.columns == clash.columns and good.count() == sum(q for *_, q in labelled())
    assert quality_rules.keep_good(clash.limit(0), model).count() == 0


def test_line_field(spark, rows):
    data = spark.createDataFrame(labelled(), "doc_id long, text string, quality int")
    fold = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in labelled()}
    model = line_crf.train(data.drop("quality"), data.drop("text"), where=~line_crf.held_out("doc"))
    scored = {r.doc_id: r for r in line_crf.score(data, model).withColumn("held_out", line_crf.held_out()).collect()}
    assert all(scored[i].predicted == q and scored[i].held_out == fold[i] for i, _, q in labelled())
    odd = line_crf.score(rows, model, drop_text=True).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd)
    assert line_crf.score(rows, None).where("score = 0.5").count() == len(ROWS)
    lines = line_crf.label_lines(data, model).first()
    assert len(lines.line_quality) == 3


def test_forward_backward_sums_over_paths():
    import itertools

    import numpy as np

    draw = np.random.RandomState(0)
    scores, moves = draw.randn(1, 5, 2), draw.randn(2, 2)
    p, expected, logz = line_crf.forward_backward(scores, np.array([5]), moves)
    paths = {q: sum(scores[0, t, q[t]] for t in range(5)) + sum(moves[q[t], q[t + 1]] for t in range(4)) for q in itertools.product((0, 1), repeat=5)}
    z = sum(np.exp(v) for v in paths.values())
    assert abs(np.log(z) - logz[0]) < 1e-9
    for t in range(5):
        assert abs(sum(np.exp(v) for q, v in paths.items() if q[t] == 1) / z - p[0, t, 1]) < 1e-9
    assert abs(sum(np.exp(v) / z * sum(q[t] == 0 and q[t + 1] == 1 for t in range(4)) for q, v in paths.items()) - expected[0, 1]) < 1e-9


def test_held_out_quality(spark):
    """Both classifiers separate the fixture's labels on rows that they were not trained on."""
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = [(r.predicted, labels[r.doc_id]) for r in Q.op2_quality_crf(spark, folder).where("held_out").collect() if r.doc_id in labels]
    assert len(found) > 50 and sum(a == b for a, b in found) / len(found) > 0.9
    rows = {r.doc_id: r for r in Q.op7_quality_rules(spark, folder).collect()}
    passed = [(rows[i].kept, q) for i, q in labels.items() if not rows[i].base_failed]
    assert sum(a == bool(q) for a, q in passed) / len(passed) > 0.9


def test_repeated_labels_and_documents_teach_once(spark):
    from calibrant.llm import _labels

    docs = spark.createDataFrame([(1, "b")] * 50 + [(1, "a"), (2, "c"), (3, "d"), (None, "e"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 40 + [(2, 0), (3, 0), (3, 1), (None, 1), (4, 1), (2, None)], "doc_id long, quality int")
    rows, counts = _labels.sample(docs, labels, "quality")
    assert sorted((r["label"], r["text"]) for r in rows.collect()) == [(0, "c"), (1, "a")]
    assert counts == {0: 1, 1: 2}


def test_chunks_carry_whole_tables(spark, sf_dir):
    """Every document of the smallest table through chunks of a few hundred characters, as one encoding has it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    whole = {r.doc_id: r.n_tokens for r in N.count_tokens(docs, BYTES, huge=10**9).collect()}
    library = N.counter(BYTES, N.HUGE, N.CHUNK, N.OVERLAP).library
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert whole == {i: len(library.encode(t, add_special_tokens=False)) for i, t in texts.items()}
    for chunk, overlap in ((400, 64), (N.CHUNK, N.OVERLAP)):
        assert {r.doc_id: r.n_tokens for r in N.count_tokens(docs, BYTES, huge=chunk, chunk=chunk, overlap=overlap).collect()} == whole
