"""Every registered query and stage on empty tables, and on null ids and texts, empty texts and repeated rows."""

import pytest

import corpus_pipeline
from planforge.llm import queries

ROWS = {
    "documents": ("doc_id long, text string, lang string, source string, n_chars long", [(1, "one two three", "en", "s", 13), (1, "one two three", "en", "s", 13), (1, "other words of it", "en", "s", 17), (2, "", None, "s", 0), (3, None, "en", None, None), (None, "one two three", "en", "s", 13), (None, None, None, None, None), (5, "12 34", "en", "s", 5)]),
    "benchmark": ("item_id long, text string", [(1, "a test item of nine tokens that nobody has"), (2, None), (None, "")]),
    "labels": ("doc_id long, quality int, toxic int", [(1, 1, 0), (1, 0, 1), (None, 1, 1), (5, None, None)]),
    "pages": ("page_id long, url string, html string", [(1, "http://a.net/x", ""), (1, "http://b.org/y", ""), (None, None, None), (2, "", "")]),
}


@pytest.fixture(scope="module", params=["rows", "empty"])
def tables(request, spark, tmp_path_factory):
    at = tmp_path_factory.mktemp(request.param)
    for name, (schema, rows) in ROWS.items():
        spark.createDataFrame(rows if request.param == "rows" else [], schema).write.parquet(f"{at}/{name}.parquet")
    return request.param, str(at)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries(spark, tables, name):
    kind, at = tables
    got = queries.queries()[name](spark, at).collect()
    if kind == "empty" or name == "op1_decontaminate":
        assert got == []
    else:
        assert len(got) == len(ROWS["pages" if name == "op4_url_filter" else "documents"][1])


def test_stages(spark, tables):
    kind, at = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        kept[name] = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
        if name != "tokens":
            assert out.columns == docs.columns
    if kind == "empty":
        assert not any(kept.values())
    else:
        assert kept["language"] == [(0, "one two three"), (1, "one two three"), (1, "one two three"), (1, "other words of it")]
        assert len(kept["near_duplicates"]) == len(kept["passages"]) == len(kept["benchmark"]) == len(kept["tokens"]) == 8
