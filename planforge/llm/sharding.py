"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of cells. Every shard owns `vnodes` points on it; a row's
home is the first point at or after its cell, clockwise. Cells are filled in a fixed
pseudo-random order, and rows that find their shard full go on clockwise to the next
point of a shard with room, so no load passes its bound. Which rows of a cell overflow
depends only on their rank in the cell, so the placement needs the count of each cell
alone: at most `cells` numbers on the driver, whatever the input's size.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planforge.llm.common import table

CELLS = 1 << 14


def ring(shards: int, vnodes: int, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, in ring order. A shard's points don't depend on the others."""
    points = []
    for s in range(shards):
        for v in range(vnodes):
            d = hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest()
            points.append((int.from_bytes(d, "big") % cells, s))
    return sorted(points)


def capacities(total: int, shards: int, slack: float | None) -> list[int]:
    """Loads at most one apart without slack, else ceil((1 + slack) * total / shards) each."""
    if slack is None:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [math.ceil((1 + slack) * total / shards)] * shards


def place(counts: dict[int, int], shards: int, vnodes: int, slack: float | None, cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot) of each run of rows that go to one shard."""
    points = ring(shards, vnodes, cells)
    at, owner = [p[0] for p in points], [p[1] for p in points]
    room = capacities(sum(counts.values()), shards, slack)
    after = list(range(len(points)))  # the first point from here on whose shard may have room

    def find(i: int) -> int:
        path = []
        while after[i] != i:
            path.append(i)
            i = after[i]
        for p in path:
            after[p] = i
        return i

    runs = []
    order = np.random.default_rng(7).permutation(cells).tolist()
    for cell in order:
        rank, left = 0, counts.get(cell, 0)
        i = bisect_left(at, cell) % len(points)
        while left:
            i = find(i)
            s = owner[i]
            n = min(left, room[s])
            if n:
                runs.append((cell, rank, rank + n, s))
                rank, left, room[s] = rank + n, left - n, room[s] - n
            if left:
                # Full: joins the next point. All points can't be full while rows are left.
                after[i] = (i + 1) % len(points)
    first = [0] * shards
    out = []
    for cell, a, b, s in sorted(runs):
        out.append((cell, a, b, s, first[s]))
        first[s] += b - a
    return out


def shard(docs: DataFrame, key: str, shards: int, vnodes: int = 64, slack: float | None = None, tie: tuple[str, ...] = ()) -> DataFrame:
    """Add `shard` (int) and `slot` (long, gapless from 0 in each shard).

    Rows with equal keys share a home; `tie` orders them. A null key is a key like any
    other. An empty table returns no rows. Columns of the input named `shard` or `slot`
    are replaced.
    """
    cell = F.pmod(F.shiftrightunsigned(F.xxhash64(F.col(key)), 20), F.lit(CELLS)).cast("int")
    counts = {r[0]: r[1] for r in docs.select(cell.alias("c")).groupBy("c").count().collect()}
    runs = place(counts, shards, vnodes, slack)
    spark = docs.sparkSession
    # At most one row for each cell and one more for each shard that fills up.
    placed = spark.createDataFrame(runs, "__c int, __a int, __b int, shard int, __first long")
    order = [F.xxhash64(F.col(key)), F.col(key), *(F.col(t) for t in tie)]
    ranked = docs.drop("shard", "slot").withColumn("__cell", cell)
    ranked = ranked.withColumn("__rank", F.row_number().over(Window.partitionBy("__cell").orderBy(*order)) - 1)
    hit = (F.col("__cell") == F.col("__c")) & (F.col("__rank") >= F.col("__a")) & (F.col("__rank") < F.col("__b"))
    out = ranked.join(F.broadcast(placed), hit)
    out = out.withColumn("slot", F.col("__first") + F.col("__rank") - F.col("__a"))
    return out.drop("__cell", "__rank", "__c", "__a", "__b", "__first")


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law `rows`: row counts at most one apart."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    out = shard(rows, "doc_id", shards=40, tie=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
