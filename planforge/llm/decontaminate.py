"""Benchmark decontamination by spaced seeds.

A mask of fixed shape ignores some token positions, so a substituted token there doesn't hide a
match. The masks' hashes of every position of every document are joined with those of the test
items; each hit names an item and an alignment. There, tokens are compared one by one and
overlaps that tolerate substitutions are verified. All of it is DataFrame operations: the
documents stay in one code-generated scan, where the test items' hashes are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planforge.llm.common import table

#: 1 compares a position, 0 ignores it. Wherever 1 token of 8 or 2 of 13 differ, one of them fits beside those; a test goes through all places.
MASKS = ("1011111", "11100111", "1111101")
#: The fewest tokens of an item in which a token may differ.
SHORT = 8
#: The most bytes of test items that are sent to every executor; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def seed(toks: Column, at: Column, mask: str) -> Column:
    """Hash of the compared tokens of a mask at a position; null if it reaches beyond the end."""
    parts = [F.get(toks, at + F.lit(i)) for i, m in enumerate(mask) if m == "1"]
    return F.when(at + F.lit(len(mask)) <= F.size(toks), F.xxhash64(F.lit(mask), *parts))


def seeds(rows: DataFrame, keep: list[str], toks: str, at: str) -> DataFrame:
    """A row for each position and mask."""
    spread = rows.select(*keep, toks, F.explode(F.when(F.size(toks) >= min(map(len, MASKS)), F.sequence(F.lit(0), F.size(toks) - min(map(len, MASKS))))).alias(at))
    return spread.select(*keep, toks, at, F.explode(F.array(*(seed(F.col(toks), F.col(at), m) for m in MASKS))).alias("seed"))


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", window: int = 13, mismatches: int = 2) -> DataFrame:
    """Overlaps of documents with test items: (key, item, doc_start, item_start, length, same).

    An overlap is a window of `window` tokens (the whole item, if shorter) in which at most `mismatches`
    tokens differ (in a shorter item, in proportion); windows at one alignment are joined to the longest
    stretch from the first to the last token of them. `same` counts the equal tokens. Items of fewer than
    SHORT tokens must occur whole and unchanged. Null and empty texts have no overlap, nor has an empty table.
    Every row of a repeated id counts by its own text; an overlap that several of them have is listed once.
    Whole texts count, however long. Other columns aren't read, so none can clash; `key` and `item` differ in name.
    """
    bank = items.select(item, tokens(F.col(text)).alias("i_toks")).where(F.size("i_toks") > 0)
    size = bank.agg(F.coalesce(F.sum(F.length(F.array_join("i_toks", " "))), F.lit(0))).first()[0]
    small = size * len(MASKS) * 4 <= BROADCAST_BYTES
    hint = F.broadcast if small else (lambda df: df)
    long = bank.where(F.size("i_toks") >= SHORT)
    index = seeds(long, [item], "i_toks", "j").where("seed is not null").select("seed", item, "j").distinct()
    d = docs.select(key, tokens(F.col(text)).alias("d_toks")).withColumn("d_hash", F.xxhash64("d_toks"))
    spread = seeds(d, [key, "d_hash"], "d_toks", "i")
    shift = (F.col("i") - F.col("j")).alias("shift")
    if small:  # looked up where the tokens are
        hits = spread.join(hint(index), "seed").select(key, "d_hash", item, shift, "d_toks")
    else:  # only seeds are shuffled; the tokens of documents with hits are joined again
        met = spread.select(key, "d_hash", "i", "seed").where("seed is not null").join(index, "seed").select(F.col(key).alias("__key"), F.col("d_hash").alias("__hash"), item, shift).distinct()
        hits = d.join(met, F.col(key).eqNullSafe(F.col("__key")) & (F.col("d_hash") == F.col("__hash"))).select(key, "d_hash", item, "shift", "d_toks")
    hits = hits.join(hint(long), item)
    # The document's tokens that an alignment can touch travel with the hit.
    first = F.greatest(-F.col("shift"), F.lit(0))
    count = F.least(F.size("i_toks"), F.size("d_toks") - F.col("shift")) - first
    near = hits.select(key, "d_hash", item, "shift", first.alias("first"), F.slice("d_toks", F.col("shift") + first + 1, count).alias("d_part"), F.slice("i_toks", first + 1, count).alias("i_part"), F.size("i_toks").alias("n"))
    near = near.groupBy(key, "d_hash", item, "shift").agg(*(F.first(c).alias(c) for c in ("first", "d_part", "i_part", "n")))
    places = F.transform(F.zip_with("d_part", "i_part", lambda a, b: a != b), lambda x, i: F.when(x, i))
    width = F.least(F.lit(window), F.col("n"))
    near = near.withColumn("p", F.filter(places, lambda x: x.isNotNull())).withColumn("m", F.size("d_part")).withColumn("w", width).withColumn("allowed", F.floor(F.lit(mismatches) * width / window).cast("int"))
    # The first good window starts at 0 or behind a differing token, the last one ends before one or at the end.
    start = F.transform(F.concat(F.array(F.lit(-1)), "p"), lambda x, k: F.when((x + 1 + F.col("w") <= F.col("m")) & F.coalesce(F.get("p", k + F.col("allowed")) >= x + 1 + F.col("w"), F.lit(True)), x + 1))
    end = F.transform(F.concat("p", F.array("m")), lambda x, k: F.when((x >= F.col("w")) & F.coalesce(F.get("p", k - 1 - F.col("allowed")) < x - F.col("w"), F.lit(True)), x))
    near = near.withColumn("a", F.array_min(start)).withColumn("b", F.array_max(end)).where("a is not null")
    differ = F.size(F.filter("p", lambda x: (x >= F.col("a")) & (x < F.col("b"))))
    found = near.select(
        key, item, (F.col("shift") + F.col("first") + F.col("a")).cast("long").alias("doc_start"), (F.col("first") + F.col("a")).cast("long").alias("item_start"), (F.col("b") - F.col("a")).cast("long").alias("length"), (F.col("b") - F.col("a") - differ).cast("long").alias("same")
    )
    tiny = bank.where(F.size("i_toks") < SHORT)
    if not tiny.head(1):
        return found.distinct()
    whole = d.select(key, F.explode(F.array_distinct("d_toks")).alias("t"), "d_toks").join(hint(tiny.withColumn("t", F.get("i_toks", F.lit(0)))), "t")
    at = F.filter(F.sequence(F.lit(0), F.size("d_toks") - F.size("i_toks")), lambda s: F.slice("d_toks", s + 1, F.size("i_toks")) == F.col("i_toks"))
    whole = whole.where(F.size("d_toks") >= F.size("i_toks")).select(key, item, F.size("i_toks").cast("long").alias("length"), F.explode(at).alias("s"))
    whole = whole.select(key, item, F.col("s").cast("long").alias("doc_start"), F.lit(0).cast("long").alias("item_start"), "length", F.col("length").alias("same"))
    return found.unionByName(whole).distinct()


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All overlaps of `documents` with `benchmark`."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_leaked(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that overlap a test item go, with all rows of their doc_id; rows without a doc_id by themselves."""
    rows = docs.withColumn("__key", F.struct(F.col("doc_id").alias("id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("row")))
    found = leaks(rows, table(spark, sf_dir, "benchmark"), key="__key").select(F.col("__key").alias("__found")).distinct()
    return rows.join(found, F.col("__key").eqNullSafe(F.col("__found")), "left_anti").select(*docs.columns)
