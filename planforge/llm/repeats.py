"""What substring and suffix-array deduplication share: bringing the places that can repeat together.

Text is a sequence of units (words or bytes), and a window is `window` units in a row. Every window
picks an anchor: of the `gram` units in a row that it holds, those with the smallest hash, the leftmost among
equals. The choice depends on the window's units alone, so equal windows have equal anchors
at equal places. Neighbouring windows mostly share theirs: a run of windows with one anchor is a piece.

1. Thinning: one shuffle of (anchor, hash of the piece, id), distinct in each document, leaves out anchors that
   one id alone has. Nothing else is decided by hashes.
2. Each different piece is cut out of one text that has it, that of the smallest id.
3. The pieces are range-partitioned by their anchors and sorted; a method (an index or a sort) takes them in shards
   of bounded size and finds the smallest id that each of their windows occurs with. An anchor with very many pieces
   is split over partitions and shards: its windows are compared across their boundaries, by their bytes.
4. The findings, one for each different piece, go to all documents that have the piece, by its digest. An anchor or
   piece with many rows is salted or met by a broadcast of bounded size, so none of them lands in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planforge.llm.common import dropped, in_batches, integer_ids, saved, slices
from planforge.llm.textarrays import mixed, windows, words_of

#: Bits of a packed hash that hold a place among the units that are looked at together.
PLACE = np.uint64(28)
#: Bytes of text that are turned into arrays together, which stay in the processor's cache; a longer text is cut into
#: blocks that overlap by a window.
BLOCK = 1 << 16
#: Documents that are sampled to find anchors with many rows; the sample decides how rows are dealt, not the result.
SAMPLE, OFTEN = 4096, 12


class Units(NamedTuple):
    """The units of several blocks; block t has the units first[t]:first[t + 1], unit u the bytes start[u]:end[u] of data."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    grams: np.ndarray


class Spec(NamedTuple):
    unit: str  # "words" or "bytes"
    window: int
    gram: int
    key: int = 0  # of the words' hashes; random in each run, so that no text is made to collide


def eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one big-endian number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(np.uint64)


def units_of(blocks: list[bytes], spec: Spec) -> Units:
    if spec.unit == "words":
        w = words_of(blocks)
        return Units(w.data, w.start, w.end, w.first, windows(w.hashes(spec.key), spec.gram))
    data = np.frombuffer(b"".join(blocks), np.uint8)
    at = np.arange(len(data))
    first = np.cumsum([0, *map(len, blocks)])
    v = eight(data)
    grams = v.copy()
    for k in range(8, spec.gram, 8):
        k = min(k, spec.gram - 8)
        moved = np.zeros_like(v)
        moved[: max(0, len(v) - k)] = v[k:]
        grams = mixed(grams) + moved
    return Units(data, at, at + 1, first, mixed(grams)[: max(0, len(data) - spec.gram + 1)])


def blocks_of(raw: bytes, spec: Spec, most: int = BLOCK) -> Iterator[bytes]:
    """A text whole, or blocks of about `most` bytes that overlap by a window less one unit: each window is in one block."""
    if len(raw) <= most:
        yield raw
        return
    a = 0
    while True:
        b = a + most
        if spec.unit == "words":
            while b < len(raw) and raw[b] not in b" \t\n\v\f\r":
                b += 1
        block = raw[a:b]
        if b >= len(raw):
            yield block
            return
        if spec.unit == "bytes":
            yield raw[a : b + spec.window - 1]
            a = b
            continue
        parts = block.rsplit(None, spec.window - 1)
        if len(parts) < spec.window:  # very long words: the block grows until it has a window
            most *= 2
            continue
        yield block
        a += len(parts[0])


def gathered(texts: list[bytes | None], spec: Spec, most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, Units]]:
    """Groups of blocks of about `most` bytes: the number of each block's text, that of its first unit in the text, and the units."""
    rows: list[int] = []
    raws: list[bytes] = []
    size, last, shift = 0, -1, 0

    def done() -> tuple[np.ndarray, np.ndarray, Units]:
        nonlocal last, shift
        units = units_of(raws, spec)
        begin = []
        for row, n in zip(rows, np.diff(units.first).tolist(), strict=True):
            shift = shift if row == last else 0
            begin.append(shift)
            last, shift = row, shift + n - spec.window + 1
        return np.array(rows), np.array(begin), units

    for i, text in enumerate(texts):
        for block in blocks_of(text or b"", spec, most):
            if size and size + len(block) > most:
                yield done()
                rows, raws, size = [], [], 0
            rows.append(i)
            raws.append(block)
            size += len(block)
    if rows:
        yield done()


class Pieces(NamedTuple):
    """Runs of windows with one anchor: their block, the units of the first and the last window, and that of the anchor."""

    block: np.ndarray
    a: np.ndarray
    b: np.ndarray
    anchor: np.ndarray


def pieces_of(units: Units, spec: Spec) -> Pieces:
    span = spec.window - spec.gram + 1  # grams in a window
    n = int(units.first[-1]) - spec.window + 1
    if n <= 0:
        return Pieces(*(np.zeros(0, np.int64) for _ in range(4)))
    if n >> int(PLACE):
        raise ValueError("too many units together")
    # The smallest packed hash of the grams from each place on; windows share an anchor just if they share this.
    low = (units.grams >> PLACE << PLACE) | np.arange(len(units.grams), dtype=np.uint64)
    done = 1
    while done * 2 <= span:
        low = np.minimum(low[: len(low) - done], low[done:])
        done *= 2
    if done < span:
        low = np.minimum(low[: len(low) - (span - done)], low[span - done :])
    whole = np.zeros(n + 2, bool)  # windows within one block, between two that aren't
    whole[1:-1] = True
    for z in units.first[1:-1].tolist():
        whole[max(0, z - spec.window + 2) : min(z, n) + 1] = False
    same = low[1:n] == low[: n - 1]
    begin, last = whole[1:-1].copy(), whole[1:-1].copy()
    begin[1:] &= ~(same & whole[1:-2])
    last[:-1] &= ~(same & whole[2:-1])
    a, b = np.flatnonzero(begin), np.flatnonzero(last)
    anchor = (low[a] & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    return Pieces(np.searchsorted(units.first, a, side="right") - 1, a, b, anchor)


def hashes_of(units: Units, spec: Spec, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each piece's anchor and of the whole piece: of grams side by side, the last at the end."""
    last = p.b + spec.window - spec.gram
    out = (p.b - p.a).astype(np.uint64)
    for k in range(0, int((last - p.a).max()) + spec.gram if len(p.a) else 0, spec.gram):
        more = p.a + k < last + spec.gram
        out = np.where(more, mixed(out) + units.grams[np.minimum(p.a + k, last)], out)
    return units.grams[p.anchor].view(np.int64), mixed(out).view(np.int64)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a.view(np.uint64) * np.uint64(3) + mixed(b.view(np.uint64)))


def cut_out(units: Units, spec: Spec, p: Pieces) -> list[bytes]:
    """The bytes of pieces; words are parted by one space."""
    data = memoryview(units.data)
    ends = units.end[p.b + spec.window - 1].tolist() if len(p.b) else []
    out = [bytes(data[i:j]) for i, j in zip(units.start[p.a].tolist(), ends, strict=True)]
    return [b" ".join(x.split()) for x in out] if spec.unit == "words" else out


def digest(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def chosen(p: Pieces, at: np.ndarray) -> Pieces:
    return Pieces(*(x[at] for x in p))


def raw(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.binary()).to_pylist()


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Where each row's entries begin and end, and all entries."""
    return lists.offsets.to_numpy(), lists.values


def _anchors(docs: DataFrame, spec: Spec) -> DataFrame:
    """(h, seg, id, row), once for each different piece of a block: hashes of its anchor and of the whole of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, units in gathered(raw(batch.column("text")), spec):
                p = pieces_of(units, spec)
                h, seg = hashes_of(units, spec, p)
                order = np.argsort(pair_keys(h, seg), kind="stable")
                block, h, seg = p.block[order], h[order], seg[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (seg[1:] != seg[:-1]) | (block[1:] != block[:-1])
                own = pa.array(rows[block[new]])
                yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(seg[new]), batch.column("id").take(own), batch.column("row").take(own)], names=["h", "seg", "id", "row"])

    return in_batches(docs, run, "h long, seg long, id long, row int")


def _thinned(rows: DataFrame) -> DataFrame:
    """(h, seg, id, row, n, first) of anchors that more than one id has; rows come sorted by anchor.

    n is the number of rows with the piece, and `first` marks the one with the smallest id. Salted rows all stay, with n = -1.
    """
    names = ("h", "seg", "id", "row", "salt")

    def groups(h, seg, ids, row, salt):
        begin = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        several = np.minimum.reduceat(ids, begin) < np.maximum.reduceat(ids, begin)
        stays = (salt >= 0) | np.repeat(several, np.diff(np.append(begin, len(h))))
        h, seg, ids, row, salt = (c[stays] for c in (h, seg, ids, row, salt))
        order = np.lexsort((row, ids, seg, h))
        h, seg, ids, row, salt = (c[order] for c in (h, seg, ids, row, salt))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (seg[1:] != seg[:-1])
        size = np.diff(np.append(np.flatnonzero(new), len(h)))
        columns = (h, seg, ids, row, np.where(salt >= 0, -1, np.repeat(size, size)), new)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "seg", "id", "row", "n", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy() for c in names]
            held = [np.concatenate(x) for x in zip(held, own, strict=True)] if held else own
            # The last anchor may go on. Salted rows aren't compared, so they need not wait.
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[4] >= 0))
            if len(last):
                cut = int(last[-1]) + 1
                yield groups(*(c[:cut] for c in held))
                held = [c[cut:] for c in held]
        if held:
            yield groups(*held)

    return in_batches(rows, run, "h long, seg long, id long, row int, n long, first boolean")


CUT = ("lead", "h", "seg", "n", "id", "row", "anchor", "piece")


def _cut(docs: DataFrame, spec: Spec) -> DataFrame:
    """(lead, h, seg, n, id, row, anchor, piece) of the pieces that documents with lists of `parts` (h, seg, n) are asked for.

    `lead` has the anchor's own bytes, `anchor` is its place in the piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for part in slices(batch, "text"):
                keys = list(zip(part.column("id").to_pylist(), part.column("row").to_pylist(), raw(part.column("text")), strict=True))
                fresh = [i for i, k in enumerate(keys) if k != (keys[i - 1] if i else before)]  # repeated rows are neighbours
                before = keys[-1]
                del keys
                if not fresh:
                    continue
                if len(fresh) < part.num_rows:
                    part = part.take(pa.array(fresh, pa.int64()))
                edge, entries = flat(part.column("parts"))
                asked = entries.slice(edge[0], edge[-1] - edge[0])
                n = asked.field("n").to_numpy()
                wanted = pair_keys(pair_keys(asked.field("h").to_numpy(), asked.field("seg").to_numpy()), np.repeat(np.arange(part.num_rows), np.diff(edge)))
                order = np.argsort(wanted)
                wanted = wanted[order]
                for rows, _, units in gathered(raw(part.column("text")), spec):
                    p = pieces_of(units, spec)
                    h, seg = hashes_of(units, spec, p)
                    mine = pair_keys(pair_keys(h, seg), rows[p.block])
                    at = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
                    hit = np.flatnonzero(wanted[at] == mine)
                    hit = hit[np.unique(at[hit], return_index=True)[1]]
                    own = chosen(p, hit)
                    data = memoryview(units.data)
                    ends = units.end[own.anchor + spec.gram - 1].tolist() if len(hit) else []
                    leads = [bytes(data[i:j]) for i, j in zip(units.start[own.anchor].tolist(), ends, strict=True)] if spec.unit == "bytes" else [b""] * len(hit)
                    of = pa.array(rows[own.block])
                    columns = [pa.array(leads, pa.binary()), pa.array(h[hit]), pa.array(seg[hit]), pa.array(n[order[at[hit]]]), part.column("id").take(of), part.column("row").take(of)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array((own.anchor - own.a).astype(np.int32)), pa.array(cut_out(units, spec, own), pa.binary())], names=CUT)

    return in_batches(docs, run, "lead binary, h long, seg long, n long, id long, row int, anchor int, piece binary")


class Shard(NamedTuple):
    """Different pieces in the order of their anchors, their units, the smallest id of each, its anchor's number, and the anchor's place in it."""

    pieces: pa.BinaryArray
    words: list[list[bytes]] | None
    size: np.ndarray
    ids: np.ndarray
    group: np.ndarray
    anchor: np.ndarray


#: The smallest id that each window of each piece of a shard occurs with, one piece after the other.
Method = Callable[[Shard], np.ndarray]
NOWHERE = np.iinfo(np.int64).max


def _searched(rows: DataFrame, spec: Spec, method: Method, most: int, giant: int) -> DataFrame:
    """(h, seg, n, id, row, digest, a, b, least, open): the smallest id that windows a to b (end exclusive) of a piece occur with.

    Rows come sorted by anchor and piece, and all of an anchor (if it is `split`, of one of its parts) in one partition. A shard
    has whole anchors of about `most` bytes; an anchor of more than `giant` is cut. Windows of anchors that are split or
    cut may have others elsewhere; they come one by one, with their bytes as `open`. Windows of which the piece's only row is
    the first are left out.
    """
    names = ["h", "seg", "n", "id", "row", "digest", "a", "b", "least", "open"]

    def answers(t: pa.Table, open_first: bool, open_last: bool) -> pa.RecordBatch:
        t = t.combine_chunks()
        h, seg, n, ids, row, anchor, split = (t.column(c).to_numpy() for c in ("h", "seg", "n", "id", "row", "anchor", "split"))
        pieces = t.column("piece").combine_chunks()
        pieces = pieces.chunk(0) if isinstance(pieces, pa.ChunkedArray) else pieces
        words = [p.split() for p in pieces.to_pylist()] if spec.unit == "words" else None
        size = np.array([len(w) for w in words], np.int64) if words else pc.binary_length(pieces).to_numpy().astype(np.int64)
        group = np.cumsum(np.diff(h, prepend=h[:1]) != 0)
        least = method(Shard(pieces, words, size, ids, group, anchor.astype(np.int64)))
        free = size - spec.window + 1
        first = np.cumsum(free) - free
        piece = np.repeat(np.arange(len(h)), free)
        wide = (split | (group == 0) & open_first | (group == group[-1]) & open_last)[piece]
        edge = wide.copy()
        edge[1:] |= least[1:] != least[:-1]
        edge[first] = True
        begin = np.flatnonzero(edge)
        stop = np.append(begin[1:], len(least))
        own = piece[begin]
        told = (least[begin] != NOWHERE) & (wide[begin] | (n[own] > 1) | (least[begin] < ids[own]))
        begin, stop, own = begin[told], stop[told], own[told]
        a, b = begin - first[own], stop - first[own]
        marks: dict[int, bytes] = {i: digest(pieces[i].as_py()) for i in np.unique(own).tolist()}
        seen: list[bytes | None] = [None] * len(own)
        for k in np.flatnonzero(wide[begin]).tolist():
            i, at = int(own[k]), int(a[k])
            seen[k] = b" ".join(words[i][at : at + spec.window]) if words else pieces[i].as_py()[at : at + spec.window]
        columns = [*(pa.array(x[own]) for x in (h, seg, n, ids, row)), pa.array([marks[i] for i in own.tolist()], pa.binary())]
        columns += [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(least[begin]), pa.array(seen, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total, goes_on = 0, False

        def size(batch: pa.RecordBatch) -> int:
            return pc.sum(pc.binary_length(batch.column("piece"))).as_py() + 64 * batch.num_rows

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held.append(batch.slice(at, 256))
                total += size(held[-1])
                if total < most:
                    continue
                t = pa.Table.from_batches(held)
                h = t.column("h").to_numpy()
                others = np.flatnonzero(h != h[-1])
                if len(others):  # the last anchor waits for the rest of it
                    cut = int(others[-1]) + 1
                    yield answers(t.slice(0, cut), goes_on, False)
                    t, goes_on = t.slice(cut), False
                    total = sum(map(size, t.to_batches()))
                if total >= giant:
                    yield answers(t, True, True)
                    t, goes_on, total = t.slice(t.num_rows), True, 0
                held = [b for b in t.to_batches() if b.num_rows]
        if held:
            yield answers(pa.Table.from_batches(held), goes_on, False)

    return in_batches(rows, run, "h long, seg long, n long, id long, row int, digest binary, a int, b int, least long, open binary")


def _often(rows: DataFrame, spec: Spec, part: int, least: int) -> DataFrame:
    """(h, often, parts): anchors with many rows in a sample of documents, at most 65,536, those with the most.

    `parts` is how many parts an anchor's pieces are dealt into, each of about `part` pieces if no two rows share one.
    """
    n = rows.count()
    share = min(1.0, SAMPLE / max(1, n))
    found = _anchors(rows.sample(share, 1), spec).groupBy("h").agg(F.count("*").alias("rows")).where(F.col("rows") >= least)
    found = found.orderBy(F.desc("rows"), "h").limit(1 << 16)
    return found.select("h", F.lit(True).alias("often"), F.ceil(F.col("rows") / share / part).alias("parts"))


def met(findings: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """Rows joined with the findings of their piece. Pieces with over an 8192nd of all rows are fewer than 8192; theirs are broadcast."""
    on = ["h", "seg"]
    many = F.col("n") > max(OFTEN, total // 8192)
    hot = findings.where(many)
    out = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(on).distinct()), on, "left_anti")
    return out.unionByName(rest.join(findings.where(~many), on))


def repeated(docs: DataFrame, key: str, text: str, spec: Spec, method: Method, most: int = 1 << 20, giant: int = 16 << 20, part: int = 1_000_000, often_rows: int = OFTEN) -> DataFrame:
    """(id, row, parts): for each row of `docs` (by its id and the hash of its text) the pieces with windows that a smaller id has.

    An entry of `parts` is (h, digest, a, b): windows a to b of every piece with this anchor hash and digest.
    Rows with a null id, or of fewer units than a window, are left out. Ids are integers.
    """
    integer_ids(docs, key)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.hash(text).alias("row"), F.col(text).alias("text")).where("id is not null and text is not null")
    often = saved(_often(rows, spec, part, often_rows), "often")
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("id", "row"), F.lit(1024))).otherwise(F.lit(-1))
    dealt = _anchors(rows, spec).join(F.broadcast(often), "h", "left").select("h", "seg", "id", "row", salt.cast("int").alias("salt"))
    shared = saved(_thinned(dealt.repartition("h", "salt").sortWithinPartitions("h")), "anchors")
    # A piece that one row alone has (n = 1) gets its findings without a join.
    counted = shared.where("n < 0").groupBy("h", "seg").agg(F.min(F.struct("id", "row")).alias("first"), F.greatest(F.count("*"), F.lit(2)).alias("n"))
    asked = shared.where("n > 0 and first").select("id", "row", "h", "seg", "n").unionByName(counted.select("first.id", "first.row", "h", "seg", "n"))
    lists = asked.groupBy("id", "row").agg(F.collect_list(F.struct("h", "seg", "n")).alias("parts"))
    cut = saved(_cut(rows.join(lists, ["id", "row"]).select("id", "row", "text", "parts"), spec), "pieces")
    common = saved(shared.where("n <> 1").select("h", "seg", "id", "row"), "common")
    dropped(shared)
    total = common.count()
    split = F.coalesce(F.col("parts") > 1, F.lit(False))
    dealt = cut.join(F.broadcast(often), "h", "left").withColumn("split", split).withColumn("part", F.when(split, F.pmod("seg", "parts")).otherwise(F.lit(0)))
    dealt = dealt.select(*CUT, "split", "part").repartitionByRange("lead", "h", "part").sortWithinPartitions("lead", "h", "part", "seg")
    found = saved(_searched(dealt, spec, method, most, giant), "found")
    dropped(cut)
    dropped(often)
    wide = found.where("open is not null")
    across = wide.groupBy("open").agg(F.min("least").alias("lowest"))
    wide = wide.join(across, "open").drop("least", "open").withColumnRenamed("lowest", "least")
    findings = found.where("open is null").drop("open").unionByName(wide)
    parts = met(findings.where("n > 1").drop("id", "row"), common, total).unionByName(findings.where("n = 1")).where("least < id")
    return parts.groupBy("id", "row").agg(F.collect_list(F.struct("h", "digest", "a", "b")).alias("parts"))


#: The columns that removal adds, after the name of its units' number.
REMOVED = "n_removed long, removed array<struct<start: long, end: long>>"
#: The kept part of a text and how many units have gone, from the text and the runs to remove.
Finish = Callable[[bytes, list[tuple[int, int]]], tuple[object, int]]


def without(docs: DataFrame, key: str, text: str, spec: Spec, method: Method, finish: Finish, kept: str, **kw) -> DataFrame:
    """Every row of `docs` with `kept`, the number of its units, `n_removed`, and `removed`: the maximal runs (start, end) of units that repeated windows cover.

    A row's own pieces are looked up among its `parts` by their digests.
    """
    names = ["kept", f"n_{spec.unit}", "n_removed", "removed"]
    rest = docs.drop(*names)
    parts = repeated(rest, key, text, spec, method, **kw).select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("parts").alias("__parts"))
    joined = rest.join(parts, (rest[key].cast("long") == F.col("__id")) & (F.hash(rest[text]) == F.col("__row")), "left").drop("__id", "__row")
    columns = rest.columns

    def covered(batch: pa.RecordBatch, texts: list[bytes | None]) -> tuple[list[int], list[list[tuple[int, int]]]]:
        edge, entries = flat(batch.column("__parts"))
        mine = entries.slice(edge[0], edge[-1] - edge[0])
        of = np.repeat(np.arange(len(texts)), np.diff(edge))
        asked = np.unique(pair_keys(mine.field("h").to_numpy(), of))
        known: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        for row, mark, a, b in zip(of.tolist(), *(mine.field(c).to_pylist() for c in ("digest", "a", "b")), strict=True):
            known.setdefault((row, mark), []).append((a, b))
        counts = [0] * len(texts)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        for rows, begin, units in gathered(texts, spec):
            for row, shift, n in zip(rows.tolist(), begin.tolist(), np.diff(units.first).tolist(), strict=True):
                counts[row] = shift + n
            if not (edge[rows + 1] > edge[rows]).any():
                continue
            p = pieces_of(units, spec)
            h = hashes_of(units, spec, p)[0]
            mine = pair_keys(h, rows[p.block])
            own = chosen(p, np.flatnonzero(asked[np.minimum(np.searchsorted(asked, mine), len(asked) - 1)] == mine))
            zero = (units.first[:-1] - begin)[own.block]
            for row, piece, start in zip(rows[own.block].tolist(), cut_out(units, spec, own), (own.a - zero).tolist(), strict=True):
                for a, b in known.get((row, digest(piece)), ()):
                    spans[row].append((start + a, start + b - 1 + spec.window))
        return counts, [merged(s) for s in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                texts = raw(batch.column(text))
                counts, spans = covered(batch, texts)
                done = [finish(t or b"", s) for t, s in zip(texts, spans, strict=True)]
                made = [
                    pa.array([d[0] for d in done], pa.string() if spec.unit == "words" else pa.binary()),
                    pa.array(counts, pa.int64()),
                    pa.array([d[1] for d in done], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ]
                yield pa.RecordBatch.from_arrays([*batch.select(columns).columns, *made], names=[*columns, *names])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), f"kept {kept}, n_{spec.unit} long, {REMOVED}"])
    return in_batches(joined, run, fields)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching intervals as one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
