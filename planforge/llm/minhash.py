"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes its set of word shingles (64-bit hashes of words' BLAKE2 digests), a signature of one byte for
   each of HASHES minhashes, and a 128-bit digest of the whole set. Texts with equal sets are one class from here on,
   and classes have numbers of their own, so that a repeated id joins nothing.
2. Signatures are cut into bands; texts that agree on a band share a bucket.
3. Candidates of a bucket are compared batch by batch of their signatures. A pair is dropped as soon as the
   posterior probability of a similarity at the threshold or above falls under the chosen miss probability;
   the survivors are verified on their full sets.
4. A bucket isn't expanded into its pairs. First, each member meets the smallest; the links found join
   members to components. Then those that aren't in the component of the smallest meet all others
   of another component, in blocks of bounded size that hold the full sets: what the signatures leave is verified
   there, and only links come out. Members of one component need no further link, so groups of
   copies cost about one verification a copy, and no link between components is lost.
5. Components come from label propagation with pointer jumping over the links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planforge.llm.common import dropped, in_batches, integer_ids, kept, saved, slices, table
from planforge.llm.textarrays import ASCII_LOWER, mixed, windows

BANDS, ROWS = 36, 5
HASHES = BANDS * ROWS
BATCH = 36
BLOCK = 1024


class Hashes(dict):
    """64-bit numbers of words, from their digests; `memory` bounds how many are remembered and changes speed alone."""

    def __init__(self, memory: int = 200_000):
        self.memory = memory

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.memory:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; of its whole word sequence if that is shorter than a shingle."""
    words = [t.encode().translate(ASCII_LOWER).split() if t else [] for t in texts]
    first = np.cumsum([0, *map(len, words)]).tolist()
    known = kept("words", Hashes)
    hashes = np.fromiter((known[w] for own in words for w in own), np.uint64, first[-1])
    rolled = windows(hashes, width)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(windows(hashes[a:b], b - a) ^ mixed(np.array([b - a], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


@cache
def seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    return rng.integers(0, 2**64, HASHES, dtype=np.uint64), rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES) bytes, one of each minhash. No set may be empty."""
    out = np.empty((len(sets), HASHES), np.uint8)
    xor, odd = seeds()
    k = 0
    while k < len(sets):  # blocks that stay in the processor's cache
        m, total = k, 0
        while m < len(sets) and (m == k or total + len(sets[m]) <= 1 << 15):
            total += len(sets[m])
            m += 1
        values = np.concatenate(sets[k:m])
        begin = np.cumsum([0, *(len(s) for s in sets[k : m - 1])])
        for i in range(HASHES):
            low = np.minimum.reduceat((values ^ xor[i]) * odd[i], begin)
            out[k:m, i] = (mixed(low) >> np.uint64(56)).astype(np.uint8)
        k = m
    return out


def bands_of(sigs: np.ndarray) -> np.ndarray:
    """(sets, BANDS) bucket keys: the band's number and its bytes."""
    keys = np.repeat(np.arange(BANDS, dtype=np.int64)[None], len(sigs), 0)
    for r in range(ROWS):
        keys = (keys << 8) | sigs[:, r::ROWS]
    return keys


@cache
def least_matches(similarity: float, miss: float) -> np.ndarray:
    """For each number of hashes compared, the fewest matches that leave P(similarity or more) at `miss` or above.

    The prior is uniform. Two different minhashes have the same byte once in 256 times.
    """
    j = (np.arange(4000) + 0.5) / 4000
    p = j + (1 - j) / 256
    out = np.zeros(HASHES + 1, np.int64)
    for n in range(1, HASHES + 1):
        m = np.arange(n + 1)
        like = m[:, None] * np.log(p) + (n - m)[:, None] * np.log1p(-p)
        like = np.exp(like - like.max(1, keepdims=True))
        tail = like[:, j >= similarity].sum(1) / like.sum(1)
        out[n] = np.argmax(tail >= miss) if (tail >= miss).any() else n + 1
    return out


def survivors(a: np.ndarray, b: np.ndarray, similarity: float, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the rows of a and b may be similar, and their matches. Later batches only look at what is left."""
    least = least_matches(similarity, miss)
    left = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for k in range(0, HASHES, BATCH):
        matches[left] += (a[left, k : k + BATCH] == b[left, k : k + BATCH]).sum(1)
        left = left[matches[left] >= least[min(k + BATCH, HASHES)]]
        if not len(left):
            break
    return left, matches


def fingerprints(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, n, set_key, sig) of every row; set_key and sig are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist(), width)
                full = [s for s in sets if len(s)]
                sigs = iter(signatures(full))
                keys = [set_key(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary())], names=["id", "n", "set_key", "sig"]
                )

    return in_batches(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), run, "id long, n long, set_key binary, sig binary", "words")


def buckets(classes: DataFrame) -> DataFrame:
    """(bucket, id) for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = bands_of(matrix(batch.column("sig")))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("id").to_numpy(), BANDS))], names=["bucket", "id"])

    return in_batches(classes.select("id", "sig"), run, "bucket long, id long")


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def likely(pairs: DataFrame, sets: DataFrame, similarity: float, miss: float) -> DataFrame:
    """The pairs (a, b) that their signatures leave over."""
    sig_a, sig_b = (sets.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, _ = survivors(matrix(batch.column("sig_a")), matrix(batch.column("sig_b")), similarity, miss)
                yield batch.select(["a", "b"]).take(pa.array(left))

    return in_batches(pairs.join(sig_a, "a").join(sig_b, "b").select("a", "b", "sig_a", "sig_b"), run, "a long, b long")


def set_table(docs: DataFrame, classes: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, set, sig) of classes (id, first, set_key): the full sets, from texts of the class's first id, and their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist(), width)
                # A first id that repeats also brings texts of other classes.
                own = [i for i, k in enumerate(part.column("set_key").to_pylist()) if len(sets[i]) and set_key(sets[i]) == k]
                sets = [sets[i] for i in own]
                sigs = [row.tobytes() for row in signatures(sets)]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(own, pa.int64())), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(sigs, pa.binary())], names=["id", "set", "sig"])

    rows = docs.select(F.col(key).cast("long").alias("first"), F.col(text).alias("text")).join(classes, "first").select("id", "set_key", "text")
    return in_batches(rows, run, "id long, set binary, sig binary", "words").dropDuplicates(["id"])


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    set_a, set_b = (sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("set_a"), batch.column("set_b")
            keep = [alike(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), percent) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return in_batches(pairs.join(set_a, "a").join(set_b, "b").select("a", "b", "set_a", "set_b"), run, "a long, b long")


def crossing(members: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float, percent: int, miss: float) -> DataFrame:
    """Verified links (a, b) between members of different labels that share a bucket.

    members (bucket, id, hub) meet in groups by the bucket's smallest id, its hub; `mask` has the bands in which
    they do, and a pair is compared in the group of the first band it shares. Ids with the hub's label need no link among each
    other. Every other id of a group is a query; members and queries are dealt into blocks, and each pair of
    blocks is one unit of work with the full sets at hand, so pairs are never rows. A query
    that has found a link to a label is not compared with that label again.
    """
    grouped = members.groupBy("hub", "id").agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftright(bucket, {8 * ROWS}) as int)))").alias("mask"))
    named = grouped.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = saved(named, "named")
    of_hub = named.where("id = hub").select("hub", F.col("label").alias("main"))
    sizes = named.join(of_hub, "hub").groupBy("hub").agg(F.first("main").alias("main"), F.count("*").alias("n"), F.count_if(F.col("label") != F.col("main")).alias("rare")).where("rare > 0")
    n_blocks, n_queries = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n", "rare"))
    rows = named.join(sizes, "hub").withColumn("h", F.xxhash64("id")).join(sets, "id")
    kept = ["hub", "id", "mask", "label", "sig", "set"]
    member = rows.select(*kept, F.pmod("h", n_blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), n_queries - 1)).alias("part"), F.lit(False).alias("query"), (F.col("label") == F.col("main")).alias("settled"))
    query = rows.where("label <> main").select(*kept, F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"), F.pmod("h", n_queries).cast("int").alias("part"), F.lit(True).alias("query"), F.lit(False).alias("settled"))

    def met(rows: pa.RecordBatch) -> list[tuple[int, int]]:
        ids, masks, labels = (rows.column(c).to_numpy() for c in ("id", "mask", "label"))
        query, settled = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("query", "settled"))
        sigs, sets = matrix(rows.column("sig")), rows.column("set")
        at = np.flatnonzero(~query)
        bands = np.ascontiguousarray(sigs[at]).reshape(len(at), BANDS, ROWS)
        found = []
        for x in np.flatnonzero(query).tolist():
            ok = (labels[at] != labels[x]) & (settled[at] | (ids[at] > ids[x])) & ((masks[at] & masks[x]) != 0)
            y = np.flatnonzero(ok)
            if not len(y):
                continue
            first = (bands[y] == sigs[x].reshape(BANDS, ROWS)).all(2).argmax(1)
            y = at[y[((masks[at[y]] & masks[x]) >> first) & 1 == 1]]
            left, matches = survivors(np.broadcast_to(sigs[x], (len(y), HASHES)), sigs[y], similarity, miss)
            own = np.frombuffer(sets[x].as_buffer(), np.uint64)
            done = set()
            for z in y[left[np.argsort(-matches[left], kind="stable")]].tolist():
                if labels[z] not in done and alike(own, np.frombuffer(sets[z].as_buffer(), np.uint64), percent):
                    done.add(labels[z])
                    found.append((min(int(ids[x]), int(ids[z])), max(int(ids[x]), int(ids[z]))))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in _ended(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                rest.append(batch)
            if not rest:
                continue
            rows = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            k = [rows.column(c).to_numpy() for c in ("hub", "block", "part")]
            new = np.flatnonzero((k[0][1:] != k[0][:-1]) | (k[1][1:] != k[1][:-1]) | (k[2][1:] != k[2][:-1])) + 1
            edges = [0, *new.tolist(), rows.num_rows]
            if batch is None:
                rest = []
            else:  # the last group may go on
                rest = [rows.slice(edges[-2])]
                edges.pop()
            found = [pair for a, b in zip(edges[:-1], edges[1:], strict=True) for pair in met(rows.slice(a, b - a))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    dealt = member.unionByName(query).repartition("hub", "block", "part").sortWithinPartitions("hub", "block", "part")
    return in_batches(dealt, run, "a long, b long").distinct()


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in links (a, b): the smallest id it is connected with.

    Each round takes the smallest label among an id and its neighbours and then that label's label,
    so long chains halve. Rounds end when no label changes.
    """
    edges = saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels", release=False)
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        low = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("far"))
        after = saved(low.join(jump, "low", "left").select("id", "was", F.least("low", F.coalesce("far", "low")).alias("label")), "labels", release=False)
        dropped(labels)
        labels = after.select("id", "label")
        if not after.where("was <> label").head(1):
            dropped(edges)
            return labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    component_id is the smallest id that links (100 * intersection >= percent * union of the shingle sets) lead to.
    A row without words has an empty set and is linked with nothing. A row with a null id is kept, is linked with
    nothing and has no component_id. Ids are integers; each row of a repeated id counts by its own text, and a repeated
    row is returned as often as it comes. Whole texts count, however long. Other columns aren't returned, so none
    can clash. An empty table returns no rows.
    """
    integer_ids(docs, key)
    similarity = percent / 100
    prints = saved(fingerprints(docs, key, text, width), "prints")
    classes = prints.where("n > 0 and id is not null").groupBy("set_key").agg(F.min(F.struct("id", "sig")).alias("least"))
    # Written with their numbers, which stay as they are from then on.
    classes = saved(classes.select("set_key", F.monotonically_increasing_id().alias("id"), F.col("least.id").alias("first"), "least.sig"), "classes")
    spread = buckets(classes)
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1")
    members = saved(spread.join(sizes, "bucket"), "members")
    wanted = classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "first", "set_key")
    sets = saved(set_table(docs, wanted, key, text, width), "sets")
    stars = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    near = saved(verified(likely(stars, sets, similarity, miss), sets, percent), "links")
    labels = components(near)
    far = saved(crossing(members, labels, sets, similarity, percent, miss), "links")
    dropped(labels)
    labels = components(near.union(far))
    named = classes.join(labels, "id", "left").select("set_key", "first", F.coalesce("label", "id").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    owner = saved(named.join(least, "label").select("set_key", "component_id"), "owner")
    for used in (classes, members, sets, near, far, labels):
        dropped(used)
    out = prints.select("id", "n", F.when(F.col("id").isNotNull(), F.col("set_key")).alias("set_key")).join(owner, "set_key", "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    """Components of all documents over sets of distinct 4-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4).withColumnRenamed("id", "doc_id")


def keep_first(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates over 5-word shingles, the rows of the smallest doc_id stay; so do all rows with a null doc_id.

    A doc_id stays if one of its rows does. An empty table, and one without any links, stay as they are.
    """
    kept_ids = near_duplicates(docs).where("kept").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(kept_ids, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
