"""Boxes around titled drawings from text blocks and vector paths alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planforge.functions.rect import Rect
from planforge.functions.text import is_heuristic_title, strip


def heuristic_titles(text_blocks: DataFrame) -> DataFrame:
    t = text_blocks.where("block_type = 0").withColumn("text", strip(F.col("text")))
    return t.where(is_heuristic_title(F.col("text"))).select("page_id", "block_no", "text", "x0", "y0", "x1", "y1")


def heuristic_boxes(text_blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each title with the union of the vectors that meet its search area, clamped and padded."""
    w = F.col("x1") - F.col("x0")
    high = F.greatest(w * 6.0, F.lit(300.0))
    t = heuristic_titles(text_blocks).withColumn("high", high)
    area = Rect(F.col("x0") - w * 2.5, F.col("y0") - F.col("high"), F.col("x1") + w * 2.5, F.col("y1") + 20)
    t = t.select("*", *area.named("s"))
    v = vectors.select("page_id", *Rect.of().named("v"))
    hit = Rect.of("v").meets(Rect.of("s"))
    own = ["page_id", "block_no", "text", "x0", "y0", "x1", "y1", "high", "sx0", "sy0", "sx1", "sy1"]
    u = t.join(v, (t.page_id == v.page_id) & hit, "left").drop(v.page_id).groupBy(*own)
    u = u.agg(F.min("vx0").alias("ux0"), F.min("vy0").alias("uy0"), F.max("vx1").alias("ux1"), F.max("vy1").alias("uy1"))
    top = F.when(F.col("uy1") - F.col("uy0") > F.col("high") * 1.5, F.col("y0") - F.col("high")).otherwise(F.col("uy0"))
    box = Rect(F.col("ux0"), top, F.col("ux1"), F.col("uy1")).union(Rect.of())
    search = Rect.of("s")
    final = Rect(*(F.when(F.col("ux0").isNull(), s).otherwise(b) for s, b in zip(search, box, strict=True))).grown(15, 15, 15, 15)
    return u.select("page_id", "block_no", F.col("text").alias("beam_id"), "x0", "y0", "x1", "y1", *final.named("b"))


def page_summary(page_dims: DataFrame, text_blocks: DataFrame, vectors: DataFrame, most: int = 50) -> DataFrame:
    """A page's size, counts, texts in order, and its first vectors."""
    t = text_blocks.where("block_type = 0").withColumn("text", strip(F.col("text"))).where("text <> ''")
    t = t.groupBy("page_id").agg(F.count("*").alias("n_texts"), F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]).alias("texts"))
    v = vectors.groupBy("page_id").agg(F.count("*").alias("n_vectors"), F.slice(F.array_sort(F.collect_list("vec_seq")), 1, most).alias("first_vectors"))
    out = page_dims.join(t, "page_id", "left").join(v, "page_id", "left")
    return out.select(
        "page_id", "page_w", "page_h", F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"), F.array_join("texts", "|").alias("texts"), F.array_join(F.col("first_vectors").cast("array<string>"), ",").alias("first_vectors")
    )
