"""Substring and suffix-array deduplication against plain dictionaries."""

import random

import pytest

from planforge.llm import substrings, suffixes
from planforge.llm.repeats import NOWHERE, Spec



SCHEMA = "doc_id long, text string, kept int, spans string"


def corpus(seed):
    """Shared passages, copies, equal ids with other texts, null ids, and a text of several blocks."""
    r = random.Random(seed)
    vocab = ["the", "a", "é", "x", "日本", "of", "and"] + [f"w{i}" for i in range(300)]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    passages = [" ".join(words(r.randrange(14, 40))) for _ in range(5)]
    docs = []
    for _ in range(40):
        text = " ".join(words(r.randrange(0, 60)))
        for _ in range(r.randrange(3)):
            text += r.choice([" ", "\n\t", "  "]) + r.choice(passages) + " " + " ".join(words(r.randrange(4)))
        docs.append(text)
    docs += [docs[3], docs[4] + " tail", "no " * 60, "no " * 50, "", None, " \n ", docs[3], "word"]
    docs.append(" ".join(words(900)) + " " + passages[0] + " " + "é" * 3000 + " " + docs[5])
    ids = r.sample(range(1000), len(docs))
    rows = list(zip(ids, docs, strict=True)) + [(ids[0], docs[0]), (None, docs[3]), (None, None)]
    own = " ".join(f"own{k}" for k in range(30))
    return rows + [(ids[0], own), (ids[0], passages[1]), (-5, "x " + passages[2]), (-5, passages[2]), (ids[9], docs[9]), (ids[9], docs[9])]


def brute(rows, width, units):
    first = {}
    for i, t in rows:
        u = units(t)
        for k in range(len(u) - width + 1):
            if i is not None:
                key = tuple(u[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        u = units(t)
        gone = [False] * len(u)
        for k in range(len(u) - width + 1):
            if i is not None and first[tuple(u[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((i, u, gone))
    return out


def runs(gone):
    return sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))


@pytest.mark.parametrize(("seed", "kw", "batch"), [(1, {}, 10_000), (2, {"most": 50, "giant": 300}, 3), (3, {"most": 200, "part": 1, "often_rows": 2}, 5)])
def test_words(spark, seed, kw, batch):
    rows = corpus(seed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([(*r, 1, "s") for r in rows], SCHEMA)
        got = substrings.removed(df, 13, **kw).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(i, len(u), sum(g), b" ".join(w for w, x in zip(u, g, strict=True) if not x).decode(), runs(g)) for i, u, g in brute(rows, 13, lambda t: t.encode().split() if t else [])]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept, len(r.removed)) for r in got), key=repr) == sorted(want, key=repr)
    assert {r.spans for r in got} == {"s"}
    assert sum(w[2] for w in want) > 100


@pytest.mark.parametrize(("seed", "kw", "batch"), [(1, {}, 10_000), (2, {"most": 300, "giant": 700}, 3), (3, {"most": 5000, "part": 1, "often_rows": 2}, 7)])
def test_bytes(spark, seed, kw, batch):
    rows = corpus(seed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([(*r, 1, "s") for r in rows], SCHEMA)
        got = suffixes.removed(df, 50, **kw).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(i, len(u), sum(g), bytes(b for b, x in zip(u, g, strict=True) if not x), runs(g)) for i, u, g in brute(rows, 50, lambda t: (t or "").encode())]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept), len(r.removed)) for r in got), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.removed(df, 13).count() == 0
    assert suffixes.removed(df, 50).count() == 0


@pytest.mark.parametrize("tool", [substrings, suffixes])
def test_the_method_finds_all(spark, monkeypatch, tool):
    """Without its index or sort, nothing is removed: no repeat is settled beside it."""
    import numpy as np

    for name in ("matching", "sorting"):
        monkeypatch.setattr(tool, name, lambda window: lambda shard: np.full(int((shard.size - window + 1).sum()), NOWHERE), raising=False)
    df = spark.createDataFrame([(i, t) for i, t in corpus(4)], "doc_id long, text string")
    got = tool.removed(df, 13 if tool is substrings else 50)
    assert got.count() == len(corpus(4))
    assert got.where("n_removed > 0").count() == 0


def test_ids_are_integers(spark):
    with pytest.raises(TypeError, match="integer"):
        substrings.removed(spark.createDataFrame([("a", "text")], "doc_id string, text string"), 13)


@pytest.mark.parametrize("unit", ["words", "bytes"])
def test_blocks_hold_each_window_once(unit):
    from planforge.llm.repeats import gathered

    r = random.Random(3)
    spec = Spec(unit, 13, 6)
    texts = [" ".join("ab"[r.randrange(2)] * r.choice([1, 2, 9, 300]) for _ in range(n)) for n in (0, 1, 12, 13, 200)]
    for most in (20, 100, 1000, 10_000):
        got = [[] for _ in texts]
        for rows, begin, units in gathered([t.encode() for t in texts], spec, most):
            for k, row in enumerate(rows.tolist()):
                raw = [units.data[units.start[u] : units.end[u]].tobytes() for u in range(units.first[k], units.first[k + 1])]
                got[row] += [(int(begin[k]) + i, raw[i : i + 13]) for i in range(len(raw) - 12)]
        for text, windows in zip(texts, got, strict=True):
            own = text.encode().split() if unit == "words" else [bytes([b]) for b in text.encode()]
            assert windows == [(i, own[i : i + 13]) for i in range(len(own) - 12)]


@pytest.mark.parametrize("spec", [Spec("bytes", 50, 16), Spec("words", 13, 6), Spec("words", 3, 1)])
def test_pieces(spec):
    """Every window is in one piece, and its anchor is the first of its grams with the smallest hash."""
    from planforge.llm import repeats

    r = random.Random(7)
    blocks = [bytes(r.choices(b"abc ", k=n)) for n in (3000, 0, 10, 49, 50, 51, 700)] + [b"x" * 300, b"x " * 60]
    units = repeats.units_of(blocks, spec)
    p = repeats.pieces_of(units, spec)
    got = [(int(block), k, int(z)) for block, i, j, z in zip(*p, strict=True) for k in range(i, j + 1)]
    want = []
    for t in range(len(blocks)):
        for k in range(units.first[t], units.first[t + 1] - spec.window + 1):
            hashes = (units.grams[k : k + spec.window - spec.gram + 1] >> repeats.PLACE).tolist()
            want.append((t, k, k + hashes.index(min(hashes))))
    assert got == want


def test_fm_index():
    import numpy as np

    from planforge.llm.fmindex import FMIndex

    rng = np.random.default_rng(5)
    text = np.append(rng.integers(1, 4, 400), 0)
    text[[50, 51, 200]] = 0
    index = FMIndex(text, 8)
    for _ in range(200):
        pattern = rng.integers(1, 5, rng.integers(1, 8))
        lo, hi = np.zeros(1, np.int64), np.array([len(text)])
        for c in pattern[::-1]:
            if c > text.max():
                hi = lo
                break
            lo, hi = index.extend(np.array([c]), lo, hi)
        places = sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) if hi[0] > lo[0] else []
        assert places == [k for k in range(len(text) - len(pattern) + 1) if (text[k : k + len(pattern)] == pattern).all()]
    ends = np.arange(1, 51)
    length, lo, hi = index.statistics(text, ends, ends, 3)
    for e in ends.tolist():
        twice = [n for n in range(1, e + 1) if sum((text[k : k + n] == text[e - n : e]).all() for k in range(len(text) - n + 1)) > 1]
        assert length[e - 1] == max(twice, default=0)
        assert (hi[e - 1] > lo[e - 1]) == (length[e - 1] >= 3)


def test_multikey_quicksort():
    import numpy as np

    from planforge.llm.suffixes import multikey_quicksort

    data = np.frombuffer(bytes(np.random.default_rng(1).integers(97, 99, 500).tolist()) + bytes(60), np.uint8)
    at = np.arange(480)
    for length in (4, 8, 11, 16, 20):
        for group in (np.zeros(480, np.int64), data[:480].astype(np.int64)):
            want = {}
            for k in at.tolist():
                want.setdefault(data[k : k + length].tobytes(), []).append(k)
            members, begin = multikey_quicksort(data, at, length, group)
            got = sorted(sorted(g.tolist()) for g in np.split(members, begin[1:]) if len(g))
            assert got == sorted(v for v in want.values() if len(v) > 1)


def test_words_of_the_thue_morse_sequence(spark, tmp_path):
    """Words that hash alike by any polynomial modulo 2^64: each of them meets its own copies, by the registered query."""
    import hashlib

    from planforge.llm import queries

    a, b = ("".join(x[k.bit_count() % 2] for k in range(2048)) for x in ("ab", "ba"))
    tail = " ".join(f"t{k}" for k in range(12))
    rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{b} {tail}"), (4, f"{a} {tail}"), (5, f"{tail} {b}"), (6, f"{tail} {a}"), (7, f"{tail} {a}")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op3_substrings"](spark, str(tmp_path)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = [(i, len(u), sum(g), hashlib.sha256(b" ".join(w for w, x in zip(u, g, strict=True) if not x)).hexdigest()) for i, u, g in brute(rows, 13, lambda t: t.encode().split())]
    assert sorted(map(tuple, got)) == want
    assert [w[2] for w in want] == [0, 0, 13, 13, 0, 0, 13]


@pytest.mark.parametrize("seed", range(8))
def test_the_index_finds_every_occurrence(seed):
    """Pieces that are alike for long, one after the other: every row of a pattern has its own place, and each window its smallest id."""
    import numpy as np

    from planforge.llm.fmindex import FMIndex
    from planforge.llm.repeats import Shard

    r = random.Random(seed)
    pieces = []
    for _ in range(36):
        n = r.randrange(13, 21)
        piece = [b"a"] * n
        if r.random() < 0.3:
            piece[r.randrange(n)] = b"b"
        pieces.append(piece)
    ids = np.array([r.randrange(100) for _ in pieces])
    got = substrings.matching(13)(Shard(None, pieces, np.array([len(p) for p in pieces]), ids, np.zeros(len(pieces), np.int64), None))
    seen = {}
    for p, i in zip(pieces, ids.tolist(), strict=True):
        for k in range(len(p) - 12):
            seen.setdefault(tuple(p[k : k + 13]), []).append(i)
    assert got.tolist() == [min(seen[tuple(p[k : k + 13])]) for p in pieces for k in range(len(p) - 12)]
    text = np.array([x for p in pieces for x in [*(1 + (w == b"b") for w in p), 0]])
    index = FMIndex(text, 20)
    for length in (13, 16, 20):
        lo, hi = np.zeros(1, np.int64), np.array([len(text)])
        for _ in range(length):
            lo, hi = index.extend(np.array([1]), lo, hi)
        assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == [k for k in range(len(text) - length + 1) if (text[k : k + length] == 1).all()]
