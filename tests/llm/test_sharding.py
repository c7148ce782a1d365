import random
from collections import Counter, defaultdict

import pytest

from planforge.llm import sharding


def one_by_one(counts, shards, vnodes, slack):
    """The same law, row by row."""
    points = sharding.ring(shards, vnodes)
    room = sharding.capacities(sum(counts.values()), shards, slack)
    out = {}
    import numpy as np

    for cell in np.random.default_rng(7).permutation(sharding.CELLS).tolist():
        for rank in range(counts.get(cell, 0)):
            k = next((i for i, p in enumerate(points) if p[0] >= cell), 0)
            while not room[points[k][1]]:
                k = (k + 1) % len(points)
            room[points[k][1]] -= 1
            out[cell, rank] = points[k][1]
    return out


@pytest.mark.parametrize(("shards", "slack"), [(1, None), (7, None), (5, 0.25), (3, 0.0)])
def test_placement(shards, slack):
    r = random.Random(shards)
    counts = {r.randrange(sharding.CELLS): r.randrange(1, 9) for _ in range(150)}
    runs = sharding.place(counts, shards, 8, slack)
    got = {(c, k): s for c, a, b, s, _ in runs for k in range(a, b)}
    assert got == one_by_one(counts, shards, 8, slack)
    loads = Counter(got.values())
    most = sharding.capacities(sum(counts.values()), shards, slack)
    assert all(loads[s] <= most[s] for s in range(shards))


def test_movement_is_limited():
    counts = dict.fromkeys(range(0, sharding.CELLS, 2), 3)
    where = lambda n: {(c, k): s for c, a, b, s, _ in sharding.place(counts, n, 64, 0.25) for k in range(a, b)}
    before, after = where(20), where(21)
    moved = sum(before[k] != after[k] for k in before)
    assert moved < len(before) * 0.2


def test_table(spark):
    rows = [(i % 70 if i % 7 else None, f"t{i % 3}", i, "old") for i in range(500)]
    df = spark.createDataFrame(rows, "k long, text string, extra int, shard string")
    got = sharding.shard(df, "k", 6, tie=("extra",)).collect()
    assert Counter(r.extra for r in got) == Counter(range(500))
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert len(by) == 6
    again = {r.extra: (r.shard, r.slot) for r in sharding.shard(df.repartition(7), "k", 6, tie=("extra",)).collect()}
    assert again == {r.extra: (r.shard, r.slot) for r in got}
    assert sharding.shard(df.limit(0), "k", 6).count() == 0
