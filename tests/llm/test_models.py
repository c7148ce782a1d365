"""Language, toxicity and audio."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest

from planforge.llm import langid, media, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    got = {r.doc_id: r for r in queries.queries()["op2_langid"](spark, SF).collect()}
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(truth)
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _ in truth)
    held = [(got[d].lang_pred, lang) for d, lang in truth if got[d].held_out]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


@pytest.fixture(scope="module")
def model():
    return langid.Model(["the cat and the dog were here with others", "der hund und die katze waren hier", "кошка и собака были здесь вместе"] * 3, ["en", "de", "ru"] * 3)


def test_spans(spark, model):
    texts = ["the cat and the dog der hund und die katze", "", None, "123 !!", "собака", "the", "the cat"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in langid.label(df, model, penalty=3.0).collect()}
    assert [(s.start, s.end, s.lang) for s in got[0].lang_spans] == [(0, 5, "en"), (5, 10, "de")]
    assert [got[i].lang_pred for i in range(1, 7)] == ["und", "und", "und", "ru", "en", "en"]
    assert got[1].score == 0
    assert got[1].lang_spans == []
    assert langid.label(df.limit(0), model).count() == 0


def test_no_language_learned(spark):
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.label(df, langid.Model([], [])).collect()] == ["und"]


def test_stage_keeps_letters_whatever_was_learned(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2][:5]
    texts = ["the cat and the dog", "12 34", "кошка", None, ""]
    for langs in ([None] * 5, ["en", None, "ru", None, None]):
        rows = list(zip(held, texts, langs, strict=True))
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        got = langid.keep_labelled(spark, df, "")
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect())) == sorted([rows[0], rows[2]])


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 0, 6, 1, 5])
    scores = rng.normal(size=(15, 3)).astype(np.float32)
    path = langid.viterbi(scores, lengths, 0.7)
    value = lambda p, s: sum(s[k, x] for k, x in enumerate(p)) - 0.7 * sum(a != b for a, b in itertools.pairwise(p))
    at = 0
    for n in lengths:
        s = scores[at : at + n]
        if n:
            assert value(path[at : at + n], s) == pytest.approx(max(value(p, s) for p in itertools.product(range(3), repeat=int(n))), abs=1e-5)
        at += n


def test_toxicity_learns_words_and_misspellings():
    rng = np.random.default_rng(1)
    plain = [f"{a}{b}" for a in ("lor", "ips", "dol", "amet", "sit") for b in ("um", "en", "or", "is", "ale")]
    texts, labels = [], []
    for i in range(300):
        words = list(rng.choice(plain, 20))
        if i % 3 == 0:
            words[rng.integers(20)] = "worthless"
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    m = toxicity.Model(texts, labels)
    score = toxicity.Values(toxicity.Scorer(m)).scores
    assert ((score(texts) >= 0.5) == (np.array(labels) == 1)).mean() > 0.95
    clean, bad, typo = score(["lorum ipsen dolor ametis", "lorum ipsen worthless ametis", "lorum ipsen worthles ametis"])
    assert clean < typo <= bad
    assert bad > 0.5


def test_toxicity_columns(spark):
    m = toxicity.Model(["bad thing", "good thing"] * 10, [1, 0] * 10)
    df = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "bad", 3), (3, "bad", 3)], "doc_id long, text string, score int")
    got = {r.doc_id: r.score for r in toxicity.score(df, m).collect()}
    assert got[1] == got[2]
    assert got[3] > got[1]
    assert all(0 <= v <= 1 for v in got.values())
    assert toxicity.score(df.limit(0), toxicity.Model([], [])).count() == 0


def test_toxicity_held_out(spark):
    got = {r.doc_id: r for r in queries.queries()["op8_toxicity"](spark, SF).collect()}
    truth = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    seen = [(got[r.doc_id].predicted, r.toxic) for r in truth if not got[r.doc_id].held_out]
    assert sum(a == b for a, b in seen) > 0.9 * len(seen)


def test_resampling_keeps_a_tone():
    t = np.arange(8000) / media.RATE
    y = media.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    want = np.sin(2 * np.pi * 440 * np.arange(len(y)) / media.OUT_RATE)
    assert np.abs(y[50:-50] - want[50:-50]).max() < 0.02
    high = media.resample(np.sin(2 * np.pi * 7000 * t).astype(np.float32))
    assert np.abs(high[50:-50]).max() < 0.05


def test_segments():
    e = np.array([0, 0, 1, 1, 5, 1, 0, 0, 1, 0, 0, 0, 6, 6, 0], float)
    got = media.segments(e, high=0.5, low=0.0)
    assert got == [(4, 5), (12, 14)]
    assert media.segments(e, high=0.5, low=-0.4) == [(2, 6), (12, 14)]
    assert media.segments(np.zeros(4)) == []


def test_audio_round_trip(spark):
    texts = [None, "", "é" * 31, "x" * 64, "y" * 65, "long " * 5000, "y" * 65]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    rows = {r.doc_id: r for r in media.audio(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = rows[i]
        assert media.read_wav(bytes(r.media)) == (16000, want)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        table = media.read_tensors(bytes(r.tensors))
        assert table.schema.field("log_mel").type.shape == [32, 20]
        assert table["end_s"][-1].as_py() > 0
    assert rows[4].asDict() | {"doc_id": 0} == rows[6].asDict() | {"doc_id": 0}
    assert media.audio(df.limit(0)).count() == 0
