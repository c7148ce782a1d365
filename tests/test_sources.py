import pytest

from planforge.sources import files
from planforge.streaming import ingest


def test_documents_and_plugins(spark, tmp_path):
    def broken(content, page):
        if content == b"bad":
            raise ValueError("unreadable")
        return [(content.decode(), float(page))]

    for name, content in (("a.pdf", b"one"), ("b.PDF", b"bad"), ("c.txt", b"no")):
        (tmp_path / name).write_bytes(content)
    docs = files.documents(spark, str(tmp_path), any_case=True)
    assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == ["a", "b"]
    assert [r.doc_id for r in files.documents(spark, str(tmp_path)).collect()] == ["a"]
    with pytest.raises(LookupError):
        files.opened(docs, "paths")
    files.register("texts", "text string, x double", broken)
    got = {r.doc_id: (r.text, r.x, r.error) for r in files.opened(docs, "texts", [2]).collect()}
    assert got == {"a": ("one", 2.0, None), "b": (None, None, "ValueError: unreadable")}


def test_stream(spark, tmp_path):
    rows = [(0, 0, 0.0, 0.0, 1.0, 1.0, " B1 (40x60) ", 0), (0, 1, 0.0, 0.0, 1.0, 1.0, "note", 0), (0, 2, 0.0, 0.0, 1.0, 1.0, "B1 (40x60)", 1)]
    df = spark.createDataFrame(rows, ingest.TEXT_BLOCKS.removesuffix(", seen timestamp")).selectExpr("*", "timestamp'2024-01-01 00:00:00' as seen")
    df.write.parquet(str(tmp_path / "in"))
    q = ingest.titles(ingest.text_blocks(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.block_no, r.text) for r in spark.table("found").collect()] == [(0, "B1 (40x60)")]
    q = ingest.title_counts(ingest.text_blocks(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [r.n for r in spark.table("counts").collect()] == [1]
