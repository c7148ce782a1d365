"""Documents from files, and the plugins that open them.

The engine reads bytes with Spark's binary reader. What opens a drawing (its paths, texts,
raster, recognised tokens) is a plugin: a function from bytes and page number to rows. None is bundled; a missing
one is an error at planning time, and a document that fails gives a row with an error, not a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLUGINS: dict[str, tuple[Callable[[bytes, int], list[tuple]], str]] = {}


def register(name: str, schema: str, function: Callable[[bytes, int], list[tuple]]) -> None:
    """`schema` describes the rows that `function(content, page_num)` returns, in DDL."""
    PLUGINS[name] = (function, schema)


def documents(spark: SparkSession, path: str, pattern: str = "*.pdf", any_case: bool = False) -> DataFrame:
    """(doc_id, path, content) of the files of a folder, or of one file; the id is the base name without its ending.

    The pattern tells cases apart unless `any_case` is set.
    """
    glob = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in pattern) if any_case else pattern
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("doc_id"), "path", "content")


def opened(docs: DataFrame, name: str, pages: list[int] | None = None) -> DataFrame:
    """Rows of a plugin for each document and page: (doc_id, page_num, its columns, error)."""
    if name not in PLUGINS:
        raise LookupError(f"no plugin {name!r} is registered; the sources that open drawings are not bundled")
    function, schema = PLUGINS[name]
    columns = docs.sparkSession.createDataFrame([], schema).columns
    numbers = pages or [0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc_id, content in zip(frame.doc_id, frame.content, strict=True):
                for n in numbers:
                    try:
                        rows = [(doc_id, n, *r, None) for r in function(bytes(content), n)]
                    except Exception as e:  # noqa: BLE001  one broken document must not end the others
                        rows = [(doc_id, n, *[None] * len(columns), f"{type(e).__name__}: {e}")]
                    yield pd.DataFrame(rows, columns=["doc_id", "page_num", *columns, "error"])

    return docs.select("doc_id", "content").mapInPandas(run, f"doc_id string, page_num int, {schema}, error string")


class TitleClassifier:
    """Chooses the titles of a page. This one keeps texts with a dimension; another may ask a service, and is only used if given."""

    def ids(self, titles: DataFrame) -> DataFrame:
        from planforge.functions.text import has_dimension

        return titles.where(has_dimension(F.col("text"))).select("page_id", "title_id")


def confirmed(titles: DataFrame, classifier: TitleClassifier | None = None) -> DataFrame:
    return titles.join((classifier or TitleClassifier()).ids(titles), ["page_id", "title_id"], "left_semi")
