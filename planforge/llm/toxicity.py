"""Toxicity: subword-bag embeddings, averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams, so a
misspelling that was never seen shares most of them with the word it stands for. A text's vector is
the mean of its words' vectors. The softmax over it is linear, so scoring needs one number
a word: its vector's product with the difference of the two class weights.
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

WORD = regex.compile(r"[\p{L}\p{N}'@$*]+")
SIZES = (3, 4, 5)
#: The log odds of a model that has seen texts of one label only, or none: nothing is taken for toxic.
NOTHING_KNOWN = -4.0


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of `<word>` of 3 to 5 characters, and the whole `<word>`; and the first of each word."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.array([len(w) + 2 for w in words], np.int64)
    start = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(words)), length)
    left = (start + length)[owner] - np.arange(len(codes))  # characters from here to the word's end
    mix = np.uint64(0x9E3779B97F4A7C15)
    ids, owners = [], []
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, max(SIZES) + 1):
        moved = np.zeros_like(codes)
        moved[: len(codes) - n + 1] = codes[n - 1 :]
        value = (value ^ moved) * mix
        value ^= value >> np.uint64(29)
        if n in SIZES:
            at = np.flatnonzero(left >= n)
            ids.append(value[at])
            owners.append(owner[at])
    power = mix ** (np.arange(len(codes)) - start[owner]).astype(np.uint64)
    whole = np.add.reduceat(codes * power, start) * mix
    ids.append(whole ^ (whole >> np.uint64(31)))
    owners.append(np.arange(len(words)))
    all_ids, all_owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(all_owners, kind="stable")
    counts = np.bincount(all_owners, minlength=len(words))
    return (all_ids[order] % np.uint64(buckets)).astype(np.int64), np.cumsum(counts) - counts


class Model:
    """Embeddings of n-gram buckets and class weights.

    A bucket counts if at least `min_texts` of the texts hold it. Its share of a text is scaled by how rare
    it is among the texts, or else the frequent buckets would take up all the steps.
    """

    def __init__(self, texts: list[str], labels: list[int], buckets: int = 1 << 20, dim: int = 4, epochs: int = 12, rate: float = 5.0, batch: int = 64, min_texts: int = 5, least_steps: int = 450, seed: int = 1):
        self.buckets = buckets
        self.line = np.zeros(buckets, np.float32)
        self.offset = NOTHING_KNOWN
        y = np.asarray(labels, np.int64)
        if len(y) and 0 < y.sum() < len(y):
            epochs = max(epochs, -(-least_steps * batch // len(y)))
            self._fit(self._bags(texts), y, dim, epochs, rate, batch, min_texts, np.random.default_rng(seed))
        self.key = hashlib.sha256(self.line.tobytes() + str(self.offset).encode()).hexdigest()

    def _bags(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The buckets of each text and their shares, which sum to 1."""
        known: dict[str, int] = {}
        parts: list[np.ndarray] = []
        ids, shares = [], []
        for text in texts:
            words = WORD.findall((text or "").lower())
            new = [w for w in dict.fromkeys(words) if w not in known]
            if new:
                got, first = subwords(new, self.buckets)
                for w, part in zip(new, np.split(got.astype(np.int32), first[1:]), strict=True):
                    known[w] = len(parts)
                    parts.append(part)
            own = [known[w] for w in words]
            sizes = np.array([len(parts[i]) for i in own], np.int64)
            share = np.repeat(1 / sizes, sizes) / max(1, len(own))
            bucket, back = np.unique(np.concatenate([parts[i] for i in own] or [np.zeros(0, np.int32)]), return_inverse=True)
            ids.append(bucket)
            shares.append(np.bincount(back, share, minlength=len(bucket)).astype(np.float32))
            if len(known) > 100_000:  # bounds the memory, not the words that count
                known.clear()
                parts.clear()
        return ids, shares

    def _fit(self, bags: tuple[list[np.ndarray], list[np.ndarray]], y: np.ndarray, dim: int, epochs: int, rate: float, batch: int, min_texts: int, rng: np.random.Generator) -> None:
        """Softmax weights and embeddings together: plain steps for the embeddings, AdaGrad for the rest; both classes weigh the same."""
        held = np.zeros(self.buckets, np.int32)
        for part in bags[0]:
            held[part] += 1  # distinct in a text
        used = np.flatnonzero(held >= min_texts)
        place = np.full(self.buckets, -1, np.int32)
        place[used] = np.arange(len(used))
        for k, part in enumerate(bags[0]):
            keep = held[part] >= min_texts
            bags[0][k], bags[1][k] = place[part[keep]], bags[1][k][keep]
        begin = np.cumsum([0, *map(len, bags[0])])
        ids, share = np.concatenate(bags[0]), np.concatenate(bags[1])
        bags[0].clear()
        bags[1].clear()
        scale = (1 / np.sqrt(held[used] / len(y) + 0.002)).astype(np.float32)
        share *= scale[ids]
        n = len(used)
        vectors = rng.uniform(-0.1, 0.1, (n, dim)).astype(np.float32)
        weights, bias = rng.uniform(-0.5, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
        g_w = g_b = 1e-8
        weight = len(y) / (2 * np.maximum(1, np.bincount(y, minlength=2)))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), batch):
                part = order[k : k + batch]
                size = begin[part + 1] - begin[part]
                owner = np.repeat(np.arange(len(part)), size)
                at = np.arange(size.sum()) + (begin[part] - (np.cumsum(size) - size))[owner]
                i, s = ids[at], share[at]
                mean = np.stack([np.bincount(owner, s * vectors[i, d], minlength=len(part)) for d in range(dim)], 1).astype(np.float32)
                logits = mean @ weights + bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(part)), y[part]] -= 1
                delta = (p * weight[y[part]][:, None] / len(part)).astype(np.float32)
                step_w, step_b, back = mean.T @ delta, delta.sum(0), delta @ weights.T
                for d in range(dim):
                    vectors[:, d] -= rate * np.bincount(i, s * back[owner, d], minlength=n).astype(np.float32)
                g_w += (step_w**2).mean()
                g_b += (step_b**2).mean()
                weights -= 0.1 * rate * step_w / np.sqrt(g_w)
                bias -= 0.1 * rate * step_b / np.sqrt(g_b)
        self.line[used] = scale * (vectors @ (weights[:, 1] - weights[:, 0]))
        self.offset = float(bias[1] - bias[0])

    def word_values(self, words: list[str]) -> np.ndarray:
        ids, first = subwords(words, self.buckets)
        return np.add.reduceat(self.line[ids], first) / np.diff(np.append(first, len(ids)))


class Values:
    """Values of the words met so far; `memory` bounds their number and changes speed alone."""

    def __init__(self, model: Model, memory: int = 200_000):
        self.model, self.memory, self.known = model, memory, {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > self.memory:
            self.known.clear()
        known = self.known
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        if new := list({w for part in words for w in part if w not in known}):
            known.update(zip(new, self.model.word_values(new).tolist(), strict=True))
        means = np.array([sum([known[w] for w in part]) / len(part) if part else 0.0 for part in words])
        return 1 / (1 + np.exp(-np.clip(means + self.model.offset, -50, 50)))


def values_of(model: Scorer) -> Values:
    return kept(f"toxicity {model.key}", lambda: Values(model))


class Scorer:
    """What the executors need of a model."""

    def __init__(self, model: Model):
        self.buckets, self.line, self.offset, self.key = model.buckets, model.line, model.offset, model.key

    word_values = Model.word_values


def train(rows: DataFrame, text: str, label: str, per_label: int = 1200) -> Model:
    """Fit on at most `per_label` rows of bounded length of each label 0 and 1: see bounded_sample()."""
    texts, labels = [], []
    for value in (0, 1):
        part = bounded_sample(rows.where(F.col(label) == value).select(F.col(text).alias("text")), "text", per_label)
        texts += [r["text"] for r in part]
        labels += [value] * len(part)
    return Model(texts, labels)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add `score` (0 to 1) of each whole text.

    A null text, or one without words, gets the score of the bias alone. A model that has
    seen one label only, or no rows, gives each text the same low score. A column `score`
    of the input is replaced; all others stay. Repeated rows are scored alike; a text of any length is read whole.
    """
    rest = df.drop("score")
    scorer = Scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = values_of(scorer)
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values.scores(part.column(text).to_pylist()))], names=[*part.schema.names, "score"])

    return in_batches(rest, run, T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType())]), f"toxicity {scorer.key}")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text; rows whose crc32(doc_id) mod 5 is 0 are never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, sf_dir, "labels").where(F.col("toxic").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = train(docs.join(labels, "doc_id"), "text", "toxic")
    out = score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
