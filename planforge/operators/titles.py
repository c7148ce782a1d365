"""Titles: from recognised tokens to blocks. Every join is on the page with a residual range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planforge.config import DEFAULT, Config
from planforge.functions.rect import Rect
from planforge.functions.text import has_dimension, is_title_candidate, normalize_text


def cx() -> Column:
    return F.col("cx_px") / 4


def cy() -> Column:
    return F.col("cy_px") / 4


def ocr_geometry(tokens: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Sure tokens that may be titles, with centre, extent and bottom."""
    t = tokens.where((F.col("conf") > c.confidence) & is_title_candidate(F.col("text")))
    xs, ys = F.array("ax", "bx", "bx", "ax"), F.array("ay", "ay", "by_", "by_")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    return t.select(
        "page_id", "window_id", "seq", "text", mean(xs).alias("cx_px"), mean(ys).alias("cy_px"), F.array_max(ys).alias("bottom_px"), (F.array_max(ys) - F.array_min(ys)).alias("h_px"),
        (F.array_max(xs) - F.array_min(xs)).alias("w_px"), (F.array_min(xs) / c.scale).alias("left_pt"), (F.array_max(xs) / c.scale).alias("right_pt"),
    )


def search_windows(blocks: DataFrame, page_dims: DataFrame) -> DataFrame:
    """Where a block's title is looked for: 150 pt below it, or down to the next block that overlaps it by a tenth of its width."""
    b = blocks.join(page_dims, "page_id")
    o = blocks.select(F.col("page_id").alias("o_page"), F.col("block_id").alias("o_id"), *Rect.of().named("o"))
    wide = F.greatest(F.lit(0.0), F.least("x1", "ox1") - F.greatest("x0", "ox0"))
    below = (F.col("o_id") != F.col("block_id")) & (F.col("oy0") > F.col("y1")) & (wide > (F.col("x1") - F.col("x0")) * 0.1)
    near = b.join(o, (F.col("page_id") == F.col("o_page")) & below, "left").groupBy("page_id", "block_id", "x0", "y0", "x1", "y1", "page_h").agg(F.min("oy0").alias("next"))
    limit = F.least(F.col("y1") + 150, F.col("page_h"), F.coalesce(F.col("next") + 5, F.lit(float("inf"))))
    out = near.select("page_id", "block_id", (F.col("x0") - 60).alias("wx0"), (F.col("y0") - 20).alias("wy0"), (F.col("x1") + 60).alias("wx1"), F.greatest(F.col("y1") + 10, limit).alias("wy1"))
    return out.where((F.col("wx1") - F.col("wx0") > 10) & (F.col("wy1") - F.col("wy0") > 10))


def title_ids(tokens: DataFrame) -> DataFrame:
    """Numbers over the page, in the order of windows and then of recognition."""
    return tokens.withColumn("title_id", F.row_number().over(Window.partitionBy("page_id").orderBy("window_id", "seq")) - 1)


def valid_titles(titles: DataFrame) -> DataFrame:
    """The rule that stands in for a classifier: texts with a dimension are titles. The text is normalised."""
    return titles.where(has_dimension(F.col("text"))).withColumn("text", normalize_text(F.col("text")))


def near(blocks: DataFrame, titles: DataFrame, left: float, top: float, bottom: float) -> DataFrame:
    """(block, title) where the title's centre is in the block grown to the sides, above and below."""
    t = titles.drop("block_id")
    hit = Rect.of().grown(left, top, left, bottom).holds(cx(), cy())
    return blocks.join(t, "page_id").where(hit)


def internal(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    return near(blocks, titles, 10, 0, 0)


def halo(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    return near(blocks, titles, 20, 20, 20)


def reassigned(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    return near(blocks, titles, 20, 5, 20)


def _below() -> Column:
    return (F.col("right_pt") >= F.col("x0") - 60) & (F.col("left_pt") <= F.col("x1") + 60) & (cy() >= F.col("y1") - 30) & (cy() <= F.col("y1") + 150)


def below(untitled: DataFrame, titles: DataFrame) -> DataFrame:
    return untitled.join(titles.drop("block_id"), "page_id").where(_below())


def reclaimed(untitled: DataFrame, titles: DataFrame, widen_always: bool = False) -> DataFrame:
    """Blocks without a title stretched down to those below; to the sides too, if they grew or always."""
    t = titles.select("page_id", "left_pt", "right_pt", "cy_px", "bottom_px")
    low = F.max(F.col("bottom_px") / 4) + 1
    g = untitled.join(t, "page_id").where(_below()).groupBy("page_id", "block_id").agg(low.alias("low"), F.min("left_pt").alias("lo"), F.max("right_pt").alias("hi"))
    b = untitled.join(g, ["page_id", "block_id"], "left")
    grew = F.col("low") > F.col("y1")
    wide = F.col("low").isNotNull() if widen_always else F.coalesce(grew, F.lit(False))
    out = b.withColumn("nx0", F.when(wide, F.least("x0", F.col("lo") - 10)).otherwise(F.col("x0"))).withColumn("nx1", F.when(wide, F.greatest("x1", F.col("hi") + 10)).otherwise(F.col("x1")))
    out = out.withColumn("grew", F.coalesce(grew, F.lit(False))).withColumn("y1", F.when(grew, F.col("low")).otherwise(F.col("y1")))
    return out.select("page_id", "block_id", F.col("nx0").alias("x0"), "y0", F.col("nx1").alias("x1"), "y1", "grew")


def title_reclaim(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """All blocks, those without a title of their own stretched."""
    titled = internal(blocks, titles).select("page_id", "block_id").distinct()
    kept = blocks.join(titled, ["page_id", "block_id"], "left_semi").withColumn("grew", F.lit(False))
    rest = blocks.join(titled, ["page_id", "block_id"], "left_anti")
    cols = ["page_id", "block_id", "x0", "y0", "x1", "y1", "grew"]
    return kept.select(cols).unionByName(reclaimed(rest, titles).select(cols))


def claimed(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    own = internal(blocks, titles)
    rest = blocks.join(own.select("page_id", "block_id").distinct(), ["page_id", "block_id"], "left_anti")
    return own.select("page_id", "title_id").union(below(rest, titles).select("page_id", "title_id")).distinct()


def ghosts(blocks: DataFrame, titles: DataFrame, page_dims: DataFrame) -> DataFrame:
    """A block of usual size for each title that no block claims."""
    lost = titles.join(claimed(blocks, titles), ["page_id", "title_id"], "left_anti").join(page_dims, "page_id")
    box = Rect(F.greatest(F.lit(0.0), F.col("left_pt") - 15), F.greatest(F.lit(0.0), cy() - 45), F.least(F.col("page_w"), F.col("right_pt") + 15), F.least(F.col("page_h"), cy() + 10))
    return lost.select("page_id", "title_id", *box.named())


def argmin_assign(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """Each title goes to the smallest block around it, the first among equals; others are left out."""
    t = titles.select("page_id", "title_id", "cx_px", "cy_px")
    hit = near(blocks, t, 10, 5, 10)
    return hit.groupBy("page_id", "title_id").agg(F.min_by("block_id", F.struct(Rect.of().area(), F.col("block_id"))).alias("block_id"))


def titled_only(blocks: DataFrame, bridge: DataFrame) -> DataFrame:
    """Blocks with a title, numbered densely in their order."""
    kept = blocks.join(bridge.select("page_id", "block_id").distinct(), ["page_id", "block_id"], "left_semi")
    return kept.withColumn("idx", F.row_number().over(Window.partitionBy("page_id").orderBy("block_id")) - 1)


def sanity(blocks: DataFrame, bridge: DataFrame, titles: DataFrame) -> DataFrame:
    """(block, title) pairs of blocks taller than 2 pt whose title is within 10 pt."""
    t = titles.select("page_id", "title_id", "cx_px", "cy_px")
    pairs = blocks.where(F.col("y1") - F.col("y0") > 2.0).join(bridge.select("page_id", "block_id", "title_id"), ["page_id", "block_id"]).join(t, ["page_id", "title_id"])
    return pairs.where(Rect.of().grown(10, 10, 10, 10).holds(cx(), cy())).select("page_id", "block_id", "title_id")
