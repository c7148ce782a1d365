import random

import pytest

from planforge.llm import minhash


def shingles(text, width):
    words = tuple((text or "").encode().translate(minhash.ASCII_LOWER).split())
    if len(words) >= width:
        return frozenset(words[k : k + width] for k in range(len(words) - width + 1))
    return frozenset([words]) if words else frozenset()


def brute(rows, width, percent=80):
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"{r.choice('abcdefgh')}{r.randrange(400)}"
    docs = []
    for size in (30, 120, 60):
        base = [word() for _ in range(size)]
        for _ in range(40):  # from nearly equal to quite different
            copy = list(base)
            for _ in range(r.randrange(0, size // 12)):
                copy[r.randrange(size)] = word()
            docs.append(" ".join(copy))
    docs += [" ".join(word() for _ in range(r.randrange(1, 50))) for _ in range(60)]
    docs += [docs[0], docs[0].upper(), docs[0].replace(" ", "\n"), "a b", "A  B", "a b c", "é È", "É è", "", None, " \t "]
    ids = r.sample(range(5000), len(docs))
    return list(zip(ids, docs, strict=True))


@pytest.mark.parametrize(("seed", "width", "block"), [(1, 4, 1024), (2, 5, 8)])
def test_against_brute_force(spark, monkeypatch, seed, width, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", 3) for r in [*rows, rows[5]]], "doc_id long, text string, id string, n int")
    got = minhash.near_duplicates(df, width=width).collect()
    assert len(got) == len(rows) + 1
    want = brute(rows, width)
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.id == r.component_id) for r in got)
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).count() == 0


def test_only_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")
    assert sorted((r.id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()) == [(i, 0, i, True) for i in (1, 2, 3)]


def test_null_ids_are_kept_and_linked_with_nothing(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(4, text), (None, text), (None, text), (None, text + " more"), (None, ""), (None, None), (7, text + " end"), (9, "alone in here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 26, 4, True), (7, 27, 4, False), (9, 1, 9, True), (None, 26, None, True), (None, 26, None, True), (None, 27, None, True), (None, 0, None, True), (None, 0, None, True)], key=str)
    kept = minhash.keep_first(spark, df, "").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([r for r in rows if r[0] != 7], key=str)


def test_long_chain_of_links(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501)]
    r = links[:]
    random.Random(1).shuffle(r)
    got = {x.id: x.label for x in minhash.components(spark.createDataFrame(r, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_bounds_lose_no_more_than_the_miss_probability():
    import numpy as np

    rng = np.random.default_rng(0)
    same = rng.random((20_000, minhash.HASHES)) < 0.8
    a = np.zeros((20_000, minhash.HASHES), np.uint8)
    left, _ = minhash.survivors(a, (~same).astype(np.uint8), 0.8, 1e-3)
    assert len(left) >= 20_000 * (1 - 5e-3)
    left, _ = minhash.survivors(a, (rng.random(a.shape) >= 0.4).astype(np.uint8), 0.8, 1e-3)
    assert not len(left)


def test_repeated_ids_and_registered_query(spark, tmp_path):
    """Rows of one id count by their own texts; component_id is the smallest id of a group."""
    base = [f"w{k}" for k in range(40)]
    other = [f"v{k}" for k in range(40)]
    rows = [(7, " ".join(base)), (7, " ".join(other)), (9, " ".join(base + ["x"])), (3, " ".join(other + ["y"])), (5, "alone"), (None, " ".join(base)), (8, None), (7, " ".join(base))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in minhash.op5_minhash(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(7, 37, 7, True), (7, 37, 3, False), (9, 38, 7, False), (3, 38, 3, True), (5, 1, 5, True), (None, 37, None, True), (8, 0, 8, True), (7, 37, 7, True)], key=repr)
    empty = minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0
    with pytest.raises(TypeError, match="integer"):
        minhash.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
