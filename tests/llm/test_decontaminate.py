import itertools
import random
import re

from planforge.llm import decontaminate


def tokens(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items, window=13, mismatches=2):
    """Items of at least 13 tokens that a document has with at most 2 substitutions in some window of 13."""
    out = set()
    for d, t in docs:
        a = tokens(t)
        for i, q in items:
            b = tokens(q)
            w = min(window, len(b))
            allowed = mismatches * w // window
            for x in range(len(a) - w + 1):
                for y in range(len(b) - w + 1):
                    if sum(p != r for p, r in zip(a[x : x + w], b[y : y + w], strict=True)) <= allowed and w:
                        out.add((d, i))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = lambda n: [f"w{r.randrange(500)}" for _ in range(n)]
    items = [(i, " ".join(words(r.randrange(9, 40)))) for i in range(12)] + [(12, "Exact Five Tokens are, here"), (13, ""), (14, None), (12, "Exact Five Tokens are, here")]
    docs = []
    for d in range(60):
        a = words(r.randrange(0, 80))
        if d % 2:
            q = tokens(items[r.randrange(13)][1])
            if d % 3 == 0 and len(q) > 20:  # a substitution now and then, always two seeds' worth apart
                for k in range(8, len(q), 12):
                    q[k] = "other"
            a += [x.upper() for x in q] if d % 5 == 0 else q
            a += words(10)
        docs.append((d, ", ".join(a)))
    return [*docs, (60, None), (61, ""), (62, "exact five tokens are"), (62, "exact five tokens are")], items


def test_against_brute_force(spark):
    docs, items = corpus(2)
    d = spark.createDataFrame([(*x, "n") for x in docs], "doc_id long, text string, seed string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, i).collect()}
    assert got == brute(docs, items)
    assert len(got) >= 25


def test_substitutions_and_spans(spark):
    item = " ".join(f"q{k}" for k in range(30))
    words = item.split()
    words[7], words[20] = "x", "y"
    d = spark.createDataFrame([(1, "lead in " + " ".join(words) + " tail"), (2, " ".join(words[:12]))], "doc_id long, text string")
    i = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = decontaminate.leaks(d, i).collect()
    assert [(r.doc_id, r.item_id, r.doc_start, r.item_start, r.length, r.same) for r in got] == [(1, 5, 2, 0, 30, 28)]


def test_shuffled_join_and_empty(spark, monkeypatch):
    docs, items = corpus(3)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = decontaminate.leaks(d, i).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert sorted(decontaminate.leaks(d, i).collect()) == sorted(want)
    assert decontaminate.leaks(d.limit(0), i).count() == 0
    assert decontaminate.leaks(d, i.limit(0)).count() == 0


def places(n):
    """All sets of places that may differ in n tokens: of up to 2 in 13, in proportion in fewer."""
    return list(itertools.combinations(range(n), 2 * min(n, 13) // 13))


def test_masks_meet_every_placement():
    for n in range(decontaminate.SHORT, 14):
        for gone in places(n):
            assert any(all(m == "0" or s + i not in gone for i, m in enumerate(mask)) for mask in decontaminate.MASKS for s in range(n - len(mask) + 1)), (n, gone)


def test_substitutions_at_all_places(spark):
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(8, 17)]
    docs = []
    for n, text in items:
        for gone in places(n):
            docs.append((len(docs), "before it " + " ".join("other" if k in gone else w for k, w in enumerate(text.split())) + " after"))
    want = brute(docs, items)
    assert len(want) == len(docs) > 400
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, i).collect()} == want
