"""Substring deduplication over words: documents' pieces are streamed through a compressed FM-index of each shard."""

from __future__ import annotations

import secrets

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planforge.llm.common import table
from planforge.llm.fmindex import FMIndex
from planforge.llm.repeats import Method, Shard, Spec, without


def matching(window: int) -> Method:
    """Index a shard's pieces and stream them through the index; where a match reaches the window, look up the smallest id of its interval."""

    def method(shard: Shard) -> np.ndarray:
        counts = shard.size
        known: dict[bytes, int] = {}
        symbols = np.fromiter((known.setdefault(w, len(known) + 1) for ws in shard.words for w in ws), np.int64, int(counts.sum()))
        # Pieces one after the other, a separator 0 behind each.
        text = np.zeros(len(symbols) + len(counts), np.int64)
        text[np.arange(len(symbols)) + np.repeat(np.arange(len(counts)), counts)] = symbols
        begin = np.cumsum(counts + 1) - counts - 1
        index = FMIndex(text)
        free = counts - window + 1
        piece = np.repeat(np.arange(len(counts)), free)
        step = np.arange(int(free.sum())) - np.repeat(np.cumsum(free) - free, free)
        length, lo, hi = index.statistics(text, begin[piece] + step + window, step + window, window)
        least = shard.ids[piece]  # a match that is unique occurs with the piece's own id
        hit = np.flatnonzero(length >= window)
        if len(hit):
            # Intervals of patterns of one length are equal or apart.
            low, back = np.unique(lo[hit], return_inverse=True)
            size = np.zeros(len(low), np.int64)
            size[back] = (hi - lo)[hit]
            first = np.cumsum(size) - size
            rows = np.repeat(low - first, size) + np.arange(int(size.sum()))
            owner = np.searchsorted(begin, index.locate(rows), side="right") - 1
            least[hit] = np.minimum.reduceat(shard.ids[owner], first)[back]
        return least

    return method


def removed(docs: DataFrame, window: int, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Add `kept`, `n_words`, `n_removed` and `removed` to every row.

    Words are runs of anything but the bytes 20 and 09 to 0D. A window is `window` words in a row of one
    text; each word of a window whose words also start in a row of a smaller id is removed, judged on
    the input. `kept` joins the remaining words by single spaces; `removed` lists the removed runs (start,
    end) of word numbers. A null or empty text has no words and keeps the empty string; a
    text shorter than the window loses nothing. Rows with a null id neither lose words nor count against others;
    rows of one id don't count against each other, whether their texts are equal or not. A text of any length is read
    whole, in blocks. An empty table returns no rows. Columns of these names are replaced, all others stay.
    """

    def finish(raw: bytes, spans: list[tuple[int, int]]) -> tuple[str, int]:
        words = raw.split()
        at, left = 0, []
        for a, b in spans:
            left += words[at:a]
            at = b
        left += words[at:]
        return b" ".join(left).decode(), len(words) - len(left)

    return without(docs, key, text, Spec("words", window, min(6, max(1, window // 2)), secrets.randbits(64)), matching(window), finish, "string", **kw)


def op3_substrings(spark, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated 13-word windows."""
    out = removed(table(spark, sf_dir, "documents").select("doc_id", "text"), 13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def drop_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: passages of 50 words or more that a document with a smaller doc_id has go; so does a document of which nothing is left.

    Texts without such passages stay as they are, white space included; rows with a null doc_id or text stay too.
    """
    out = removed(docs, 50).where((F.col("n_removed") == 0) | (F.col("kept") != ""))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
