"""Nested export, label rows and per-document files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planforge.functions.rect import Rect
from planforge.functions.text import fixed


BEAMS = "array<struct<parent_id:int,parent_bbox:array<double>,titles:array<struct<text:string,bbox:array<double>>>,single_spans:array<array<double>>>>"


def title_boxes(titles: DataFrame) -> DataFrame:
    """A title's box in points, from its centre and size; missing values count as 0."""
    v = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("cx_px", "cy_px", "w_px", "h_px")}
    box = Rect((v["cx_px"] - v["w_px"] / 2) / 4, (v["cy_px"] - v["h_px"] / 2) / 4, (v["cx_px"] + v["w_px"] / 2) / 4, (v["cy_px"] + v["h_px"] / 2) / 4)
    return titles.select("page_id", "title_id", F.coalesce("text", F.lit("")).alias("text"), *(F.round(c, 2).alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)))


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def yolo_labels(blocks: DataFrame, page_dims: DataFrame, class_id: int = 0) -> DataFrame:
    """Centre and size of the rounded box over the page's size, each clamped on its own; pages without size give none."""
    b = blocks.join(page_dims.where("page_w > 0 and page_h > 0"), "page_id")
    r = Rect(*(F.round(c, 2) for c in Rect.of()))
    return b.select(
        "page_id", F.col("block_id").alias("parent_id"), F.lit(class_id).alias("class_id"), _unit((r.x0 + r.x1) / 2 / F.col("page_w")).alias("cx"), _unit((r.y0 + r.y1) / 2 / F.col("page_h")).alias("cy"),
        _unit((r.x1 - r.x0) / F.col("page_w")).alias("w"), _unit((r.y1 - r.y0) / F.col("page_h")).alias("h"),
    )


def label_lines(labels: DataFrame) -> DataFrame:
    return labels.withColumn("line", F.concat_ws(" ", F.col("class_id").cast("string"), *(fixed(F.col(c), 6) for c in ("cx", "cy", "w", "h"))))


def label_files(labels: DataFrame, page_dims: DataFrame) -> DataFrame:
    """The text of each page's label file; empty for a page without blocks."""
    lines = label_lines(labels).groupBy("page_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("parent_id", "line"))), lambda x: x["line"])).alias("content"))
    return page_dims.select("page_id").join(lines, "page_id", "left").na.fill("", ["content"])


def spans_of(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans (page, block, span_id, box) of each block in order; a block without any is its own span."""
    s = spans.groupBy("page_id", "block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("span_id", Rect.of().array().alias("box")))), lambda x: x["box"]).alias("spans"))
    out = blocks.join(s, ["page_id", "block_id"], "left")
    return out.withColumn("spans", F.when(F.coalesce(F.size("spans"), F.lit(0)) > 0, F.col("spans")).otherwise(F.array(Rect.of().array())))


def beam_export(blocks: DataFrame, bridge: DataFrame, titles: DataFrame, page_dims: DataFrame) -> DataFrame:
    """One nested record for each page: its size and its blocks with titles and spans, in order. Pages without blocks have an empty list."""
    t = bridge.join(title_boxes(titles), ["page_id", "title_id"])
    t = t.groupBy("page_id", "block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("title_id", "text", Rect.of().array().alias("bbox")))), lambda x: F.struct(x["text"].alias("text"), x["bbox"].alias("bbox"))).alias("titles"))
    r = F.array(*(F.round(c, 2) for c in Rect.of()))
    b = blocks.join(t, ["page_id", "block_id"], "left").withColumn("box", r)
    none = F.array().cast("array<struct<text:string,bbox:array<double>>>")
    beam = F.struct(F.col("block_id").alias("parent_id"), F.col("box").alias("parent_bbox"), F.coalesce("titles", none).alias("titles"), F.array("box").alias("single_spans"))
    g = b.groupBy("page_id").agg(F.array_sort(F.collect_list(beam)).alias("continuous_beams"))
    info = F.struct(F.col("page_id").alias("page_num"), F.round("page_w", 2).alias("width"), F.round("page_h", 2).alias("height"))
    return page_dims.join(g, "page_id", "left").select("page_id", info.alias("page_info"), F.coalesce(F.col("continuous_beams").cast(BEAMS), F.array().cast(BEAMS)).alias("continuous_beams"))


def title_summary(blocks: DataFrame, bridge: DataFrame, titles: DataFrame) -> DataFrame:
    """A line for each block: its number, its count of titles, and each as `text (X=…, Y=…)`."""
    t = bridge.join(titles.select("page_id", "title_id", "text", "cx_px", "cy_px"), ["page_id", "title_id"])
    one = lambda c: F.when(F.col(c) < 0, F.concat(F.lit("-"), fixed(-F.col(c), 1))).otherwise(fixed(F.col(c), 1))
    line = F.concat(F.coalesce("text", F.lit("null")), F.lit(" (X="), one("cx_px"), F.lit(", Y="), one("cy_px"), F.lit(")"))
    g = t.groupBy("page_id", "block_id").agg(F.count("*").alias("n"), F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.struct("title_id", line.alias("line")))), lambda x: x["line"])).alias("titles"))
    return blocks.select("page_id", "block_id").join(g, ["page_id", "block_id"], "left").select("page_id", "block_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("titles", F.lit("")).alias("titles"))


def write_documents(exports: DataFrame, path: str) -> None:
    """One JSON row for each page under its own partition; only partitions that are written are replaced."""
    out = exports.select("page_id", F.to_json(F.struct("page_info", "continuous_beams")).alias("value"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("page_id").text(path)
