"""Language identification of mixed-language text.

Script ranges narrow the candidates of each word, character n-grams score the word under
each candidate, and Viterbi with a switching penalty labels spans of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planforge.llm.common import bounded_sample, in_batches, kept, slices, table

#: Code point ranges of scripts, end exclusive.
SCRIPTS = {
    "latin": ((0x41, 0x250), (0x1E00, 0x1F00)),
    "greek": ((0x370, 0x400), (0x1F00, 0x2000)),
    "cyrillic": ((0x400, 0x530),),
    "armenian": ((0x530, 0x590),),
    "hebrew": ((0x590, 0x600),),
    "arabic": ((0x600, 0x780), (0xFB50, 0xFE00)),
    "indic": ((0x900, 0xE00),),
    "thai": ((0xE00, 0xE80),),
    "georgian": ((0x10A0, 0x1100),),
    "hangul": ((0x1100, 0x1200), (0xAC00, 0xD7B0)),
    "kana": ((0x3040, 0x3100),),
    "han": ((0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)),
}
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UND = "und"


def script_of(codes: np.ndarray) -> np.ndarray:
    """1 + the index of each code point's script in SCRIPTS; 0 for any other."""
    out = np.zeros(len(codes), np.int8)
    for i, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            out[(codes >= a) & (codes < b)] = i + 1
    return out


def grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three hashed n-grams (1, 2 and 3 letters) at each letter; the first letter of each word; the letters' scripts."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    at = np.flatnonzero(codes != 32)
    a, b, c = codes[at - 1], codes[at], codes[at + 1]
    keys = np.stack([b, (a << np.uint64(21)) | b, (a << np.uint64(42)) | (b << np.uint64(21)) | c], 1)
    keys = (keys + np.arange(1, 4, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    ids = ((keys ^ (keys >> np.uint64(32))) % np.uint64(buckets)).astype(np.int32)
    return ids, np.flatnonzero(codes[at - 1] == 32), script_of(b)


class Model:
    """Log probabilities of hashed n-grams by language, and the scripts each language uses."""

    def __init__(self, texts: list[str], langs: list[str], buckets: int = 1 << 15, share: float = 0.01):
        self.langs = sorted(set(langs))
        self.buckets = buckets
        counts = np.ones((buckets, max(1, len(self.langs))))
        seen = np.zeros((len(SCRIPTS) + 1, counts.shape[1]))
        for text, lang in zip(texts, langs, strict=True):
            k = self.langs.index(lang)
            if words := WORD.findall((text or "").lower()):
                ids, _, scripts = grams(words, buckets)
                counts[:, k] += np.bincount(ids.ravel(), minlength=buckets)
                seen[:, k] += np.bincount(scripts, minlength=len(seen))
        self.logp = (np.log(counts) - np.log(counts.sum(0))).astype(np.float32) / 3
        allowed = seen >= share * np.maximum(1, seen.sum(0))
        allowed[~allowed.any(1)] = True  # a script that no language uses narrows nothing
        self.script_cost = np.where(allowed, 0, -30).astype(np.float32)
        self.key = hashlib.sha256(self.logp.tobytes() + repr(self.langs).encode()).hexdigest()

    def word_scores(self, words: list[str]) -> np.ndarray:
        ids, first, scripts = grams(words, self.buckets)
        scores = self.logp[ids[:, 0]] + self.logp[ids[:, 1]] + self.logp[ids[:, 2]] + self.script_cost[scripts]
        return np.add.reduceat(scores, first, axis=0)




class Scores:
    """Scores of the words met so far; `memory` bounds their number and changes speed alone."""

    def __init__(self, model: Model, memory: int = 100_000):
        self.model, self.memory = model, memory
        self.ids: dict[str, int] = {}
        self.rows = np.empty((1024, len(model.langs)), np.float32)
        self.letters = np.empty(1024, np.int32)

    def of(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and lengths of all words, in order."""
        if len(self.ids) > self.memory:
            self.ids.clear()
        ids = self.ids
        new = list({w for words in texts for w in words if w not in ids})
        if new:
            n = len(ids)
            while n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
                self.letters = np.concatenate([self.letters, np.empty_like(self.letters)])
            self.rows[n : n + len(new)] = self.model.word_scores(new)
            self.letters[n : n + len(new)] = [len(w) for w in new]
            ids.update(zip(new, range(n, n + len(new)), strict=True))
        all_ids = np.fromiter((ids[w] for words in texts for w in words), np.int64, sum(map(len, texts)))
        return self.rows[all_ids], self.letters[all_ids]


def scores_of(model: Model) -> Scores:
    """One table of words for each worker and model, kept over tasks."""
    return kept(f"langid {model.key}", lambda: Scores(model))


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word of all texts at once. lengths: words of each text, in the order of `scores`.

    Changing the language between two words costs `penalty`. Ties stay, then go to the first language.
    """
    path = np.zeros(len(scores), np.int16)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return path
    start = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    best = scores[start].copy()
    came = np.empty((len(scores), scores.shape[1]), np.int8 if scores.shape[1] < 128 else np.int16)
    for t in range(1, int(size[0])):
        n = active[t]
        b, at = best[:n], start[:n] + t
        top = b.argmax(1)
        high = b.max(1)[:, None] - penalty
        stay = b >= high
        came[at] = np.where(stay, np.arange(b.shape[1]), top[:, None])
        best[:n] = np.maximum(b, high) + scores[at]
    state = best.argmax(1)
    path[start + size - 1] = state
    for t in range(int(size[0]) - 1, 0, -1):
        n = active[t]
        at = start[:n] + t
        path[at] = s = state[:n]
        state[:n] = came[at, s]
    path[start] = state
    return path


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = 3000) -> Model:
    """Fit on at most `sample_rows` labelled rows of bounded length: see bounded_sample()."""
    rows = bounded_sample(docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")), "text", sample_rows)
    return Model([r["text"] for r in rows], [r["lang"] for r in rows])


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


def label(df: DataFrame, model: Model, text: str = "text", penalty: float = 12.0, spans: bool = True) -> DataFrame:
    """Add `lang_pred`, `score` and `lang_spans` for each whole text.

    `lang_spans` are runs of words of one language (word numbers, end exclusive).
    `lang_pred` has the most letters in them (ties: the first by name) and `score` is its
    share of the letters. A null text, or one without letters, gets `und`, 0 and no spans; so does
    every text when the model has no language. Columns of these names in `df` are replaced.
    """
    names = ["lang_pred", "score", "lang_spans"] if spans else ["lang_pred", "score"]
    rest = df.drop("lang_pred", "score", "lang_spans")
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_spans", SPANS)]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = scores_of(model)
        k = len(model.langs)
        for batch in batches:
            for part in slices(batch, text):
                words = [WORD.findall(x.lower()) if x and k else [] for x in part.column(text).to_pylist()]
                lengths = np.array([len(w) for w in words], np.int64)
                scores, letters = known.of(words)
                path = viterbi(scores, lengths, penalty)
                owner = np.repeat(np.arange(len(words)), lengths)
                sums = np.bincount(owner * max(1, k) + path, weights=letters, minlength=len(words) * max(1, k)).reshape(len(words), -1)
                total = sums.sum(1)
                top = sums.argmax(1)
                pred = [model.langs[j] if n else UND for j, n in zip(top, total, strict=True)]
                columns = [pa.array(pred), pa.array(sums.max(1) / np.maximum(1, total))]
                if spans:
                    ends = np.cumsum(lengths)
                    cut = np.zeros(len(path) + 1, bool)
                    cut[1:-1] = path[1:] != path[:-1]
                    cut[ends] = cut[0] = True
                    edge = np.flatnonzero(cut)
                    made: list[list] = [[] for _ in words]
                    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                        o = owner[a]
                        first = int(ends[o] - lengths[o])
                        made[o].append({"start": a - first, "end": b - first, "lang": model.langs[path[a]]})
                    columns.append(pa.array(made, kind))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *names])

    return in_batches(rest, run, T.StructType([*rest.schema.fields, *fields[: len(names)]]), f"langid {model.key}")


def _learned(docs: DataFrame) -> Model:
    return train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))


def op2_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text; documents whose crc32(doc_id) mod 4 is 2 are never learned from."""
    docs = table(spark, sf_dir, "documents")
    out = label(docs.select("doc_id", "text"), _learned(docs))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "lang_spans")


def keep_labelled(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a letter, and null texts, go, whatever their language or its score; `lang` stays as it is.

    All labelled rows may be learned from. Where none is, no language can be told, and the letters alone decide.
    """
    model = train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    out = label(docs, model, spans=False)
    return out.where(F.col("lang_pred") != UND).select(*docs.columns)
