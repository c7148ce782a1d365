"""run() against stages written without Spark."""

import os
import random
import re

import corpus_pipeline
from planforge.llm import bpe

from .test_decontaminate import brute as leaked
from .test_minhash import brute as components
from .test_repeats import brute as repeats


def test_run(spark, tmp_path):
    r = random.Random(6)
    words = lambda n: [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnr')}{r.randrange(900)}" for _ in range(n)]
    passage, item = words(60), words(25)
    docs = []
    for i in range(40):
        a = words(r.randrange(20, 60))
        if i % 5 == 0:
            a += passage + words(5)
        if i % 7 == 3:
            a += item + words(4)
        docs.append(" ".join(a))
    docs += [docs[1], docs[2] + " end", docs[4].replace(" ", "\n"), "", None, "12 34", " ".join(passage)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [(i, t) for i, t in enumerate(docs) if t and re.search(r"[^\W\d_]", t)]
    groups = components(left, 5)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    cut = []
    for i, u, gone in repeats(left, 50, lambda t: t.split()):
        text = " ".join(w for w, g in zip(u, gone, strict=True) if not g) if any(gone) else docs[i]
        if text or not any(gone):
            cut.append((i, text))
    bad = {d for d, _ in leaked(cut, [(0, " ".join(item))])}
    left = [(i, t) for i, t in cut if i not in bad]
    codec = bpe.Codec(bpe.default_path())
    assert {i: x.text for i, x in got.items()} == dict(left)
    assert all(x.n_tokens == len(codec.encode(x.text)) and x.round_trip for x in got.values())
    assert len(left) < len(docs) - 12
    assert os.path.isdir(tmp_path)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
