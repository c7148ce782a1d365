"""Byte-level BPE: encoding by a priority queue of merge ranks, decoding by concatenation."""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planforge.llm.common import in_batches, kept, slices, table

#: Fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies, with \s as White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 stands for itself; the others take the code points from 256 on, in order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder over one vocabulary file of the tokenizers library.

    `memory` bounds the number of pieces whose ids are remembered; it changes speed alone.
    """

    def __init__(self, path: str, memory: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.start = [vocab[c] for c in letters]
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in token)
        for token, i in special.items():
            self.strings[i] = token.encode()
        self.special = special
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.pieces = regex.compile(PATTERN).findall
        self.memory, self.known = memory, {}

    def merge(self, piece: bytes) -> list[int]:
        """Apply the merges of lowest rank first, leftmost first among equals."""
        ids = [self.start[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks, queue = self.ranks, []
        for i in range(n - 1):
            if found := ranks.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # stale: one of the two symbols has been merged meanwhile
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := ranks.get((new, ids[k])):
                    heapq.heappush(queue, (found[0], i, new, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := ranks.get((ids[h], new))):
                heapq.heappush(queue, (found[0], h, ids[h], new, found[1]))
        return [x for x in ids if x >= 0]

    def _packed(self, piece: str) -> bytes:
        if len(self.known) >= self.memory:
            self.known.clear()
        self.known[piece] = out = array("I", self.merge(piece.encode())).tobytes()
        return out

    def _plain(self, text: str, out: list[bytes]) -> None:
        known = self.known.get
        for piece in self.pieces(text):
            out.append(known(piece) or self._packed(piece))

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        if self.split and any(t in text for t in self.special):
            for part in self.split.split(text):
                if part in self.special:
                    out.append(array("I", [self.special[part]]).tobytes())
                elif part:
                    self._plain(part, out)
        else:
            self._plain(text, out)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_packed(text)).tolist()

    def decode_packed(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in array("I", ids)]).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.decode_packed(array("I", ids).tobytes())


def codec(path: str) -> Codec:
    return kept(f"bpe {path}", lambda: Codec(path))


def _mapped(df: DataFrame, column: str, path: str, fields: list[T.StructField], values: Callable[[list], list[list]]) -> DataFrame:
    """Append columns that `values` makes from the list of one column's values."""
    names = [f.name for f in fields]
    rest = df.drop(*names)
    kinds = [{"BinaryType": pa.binary(), "StringType": pa.string()}[type(f.dataType).__name__] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                made = values(part.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))], names=[*part.schema.names, *names])

    return in_batches(rest, run, T.StructType([*rest.schema.fields, *fields]), f"bpe {path}")


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add `ids_le` (binary): the ids of each whole text as little-endian unsigned 32-bit integers.

    A null text counts as empty; an empty text has no ids. All other columns stay; one
    named `ids_le` is replaced.
    """
    return _mapped(df, text, path, [T.StructField("ids_le", T.BinaryType())], lambda v: [[codec(path).encode_packed(x or "") for x in v]])


def decode(df: DataFrame, path: str, ids: str = "ids_le") -> DataFrame:
    """Add `decoded` (string): the vocabulary strings of the ids, concatenated. Null ids count as none."""
    return _mapped(df, ids, path, [T.StructField("decoded", T.StringType())], lambda v: [[codec(path).decode_packed(x or b"") for x in v]])


def roundtrip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add `ids_le` and `decoded` in one pass over the text; the same values as encode() and decode()."""

    def both(v: list) -> list[list]:
        c = codec(path)
        ids = [c.encode_packed(x or "") for x in v]
        return [ids, [c.decode_packed(x) for x in ids]]

    return _mapped(df, text, path, [T.StructField("ids_le", T.BinaryType()), T.StructField("decoded", T.StringType())], both)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of the ids and of the decoded text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = roundtrip(docs, default_path())
    return out.select(
        "doc_id",
        (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def encode_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids of every text, checked by decoding them again.

    `round_trip` says whether the ids decode to the text.
    """
    out = roundtrip(docs, default_path())
    ids = F.col("ids_le")
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", "text", "lang", "source", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), ids, same.alias("round_trip"))
