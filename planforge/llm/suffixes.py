"""Suffix-array deduplication over bytes.

Suffixes are sampled: those at anchors travel, each with the windows around it. Sampled splitters range-partition them by
their leading bytes. Each bucket sorts the suffixes of its pieces by multikey quicksort, whose characters are eight
bytes, and takes the smallest id of each run of equal ones; runs at the edge of a bucket are compared across the boundary.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planforge.llm.common import table
from planforge.llm.repeats import Method, Shard, Spec, eight, without


def multikey_quicksort(data: np.ndarray, at: np.ndarray, length: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members (numbers of places in `at`) of the runs of `length` equal bytes, and where each run begins; single ones are left out.

    `group` numbers the places that may be equal; it is what partitioning has sorted already. In each round every
    group that is left is split in three by the character of its middle member: less, equal and greater. Equal ones
    go on with the next character, or form a run after the last.
    """
    steps = [*range(0, length - 8, 8), max(0, length - 8)]
    chars = eight(data)
    if length < 8:
        chars = chars >> np.uint64(8 * (8 - length))
    order = np.argsort(group, kind="stable")
    group = group[order]
    new = np.ones(len(order), bool)
    new[1:] = group[1:] != group[:-1]
    begin = np.flatnonzero(new)
    depth = np.zeros(len(begin), np.int64)
    runs: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    offset = np.array(steps)
    while len(order):
        count = np.diff(np.append(begin, len(order)))
        # Single members are done; so are groups that have no characters left.
        over = depth == len(steps)
        full = np.repeat(over & (count > 1), count)
        runs.append(order[full])
        sizes.append(count[over & (count > 1)])
        live = ~over & (count > 1)
        order, depth, count = order[np.repeat(live, count)], depth[live], count[live]
        if not len(order):
            break
        begin = np.cumsum(count) - count
        own = np.repeat(np.arange(len(begin)), count)
        char = chars[at[order] + offset[depth][own]]
        pivot = char[begin + count // 2][own]
        side = 1 + (char > pivot) - (char < pivot).astype(np.int64)
        part = own * 3 + side
        order = order[np.argsort(part, kind="stable")]
        count = np.bincount(part, minlength=3 * len(begin))
        depth = np.repeat(depth, 3)
        depth[1::3] += 1
        kept = count > 0
        count, depth = count[kept], depth[kept]
        begin = np.cumsum(count) - count
    size = np.concatenate([np.zeros(0, np.int64), *sizes])
    return np.concatenate([np.zeros(0, np.int64), *runs]), np.cumsum(size) - size


def sorting(window: int) -> Method:
    """Sort all suffixes of a bucket's pieces that have a whole window. Equal windows have equal anchors at equal places, so these part them first."""

    def method(shard: Shard) -> np.ndarray:
        data = np.frombuffer(b"".join(shard.pieces.to_pylist()), np.uint8)
        size = shard.size
        free = size - window + 1
        piece = np.repeat(np.arange(len(size)), free)
        step = np.arange(int(free.sum())) - np.repeat(np.cumsum(free) - free, free)
        at = step + (np.cumsum(size) - size)[piece]
        least = shard.ids[piece]
        members, begin = multikey_quicksort(data, at, window, shard.group[piece] * window + shard.anchor[piece] - step)
        if len(begin):
            smallest = np.minimum.reduceat(least[members], begin)
            least[members] = np.repeat(smallest, np.diff(np.append(begin, len(members))))
        return least

    return method


def removed(docs: DataFrame, window: int, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Add `kept` (binary), `n_bytes`, `n_removed` and `removed` to every row.

    Each byte of the UTF-8 text that a `window`-byte string covers which also starts in a row of a smaller id is
    removed, judged on the input. `removed` lists the maximal removed runs (start, end); `kept` may be cut within a character. A null or
    empty text has no bytes; a text shorter than the window loses nothing. Rows with a null id neither lose bytes nor
    count against others; rows of one id don't count against each other, whether their texts are equal or not. A text of any
    length is read whole, in blocks. An empty table returns no rows. Columns of these names are replaced, all others stay.
    """
    if window < 16:
        raise ValueError("a window has at least 16 bytes")

    def finish(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
        at, left = 0, []
        for a, b in spans:
            left.append(raw[at:a])
            at = b
        left.append(raw[at:])
        kept = b"".join(left)
        return kept, len(raw) - len(kept)

    return without(docs, key, text, Spec("bytes", window, min(16, window // 2)), sorting(window), finish, "binary", **kw)


def op6_suffixes(spark, sf_dir: str) -> DataFrame:
    """All documents without the bytes of repeated 50-byte strings."""
    out = removed(table(spark, sf_dir, "documents").select("doc_id", "text"), 50)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
