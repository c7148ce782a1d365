import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from planforge.llm import bpe


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_path()), bpe.Codec(bpe.default_path(), memory=50)


EXTRA = ["", "a<|endoftext|>b  <|endoftext|>", "don't I'LL we've", "  x \n\n y\t\x1c z\x85　q", "日本語 12½ 🙂👍🏽", "a" * 5000, "\x00\x01", " " * 300, "'s 's'"]


def test_known_texts(both):
    library, own = both
    for t in EXTRA:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(both, text):
    library, own = both
    ids = own.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == text


def test_any_ids_decode(both):
    library, own = both
    for ids in ([120, 121, 200], [50256, 5, 255], list(range(180, 260))):
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hello  world", "z"), (3, "hello  world", "z")], "doc_id long, text string, ids_le string")
    path = bpe.default_path()
    got = bpe.decode(bpe.encode(df, path), path).orderBy("doc_id").collect()
    assert [(r.doc_id, len(r.ids_le) // 4, r.decoded) for r in got] == [(1, 0, ""), (2, 0, ""), (3, 3, "hello  world"), (3, 3, "hello  world")]
    both_ways = bpe.roundtrip(df, path).orderBy("doc_id").collect()
    assert [(bytes(r.ids_le), r.decoded) for r in both_ways] == [(bytes(r.ids_le), r.decoded) for r in got]
    assert bpe.roundtrip(df.limit(0), path).count() == 0
