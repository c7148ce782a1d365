"""Pages as a stream: text blocks arrive as files, titles leave as they are found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planforge.operators.heuristic import heuristic_titles

TEXT_BLOCKS = "page_id long, block_no int, x0 double, y0 double, x1 double, y1 double, text string, block_type int, seen timestamp"


def text_blocks(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(TEXT_BLOCKS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def titles(blocks: DataFrame) -> DataFrame:
    """A row for each title, without state."""
    return heuristic_titles(blocks)


def title_counts(blocks: DataFrame, window: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Titles by window of arrival; rows later than the watermark are left out."""
    found = blocks.withWatermark("seen", late).where("block_type = 0").where(F.col("text").rlike(r"\([0-9]+[xX*][0-9]+\)"))
    return found.groupBy(F.window("seen", window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
