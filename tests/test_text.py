"""The normaliser against cases derived by hand."""

import pytest
from pyspark.sql import functions as F

from planforge.functions import text as X

CASES = [
    (None, ""),
    ("", ""),
    ("LLM沒有東西", ""),
    ("LLM看不出來", ""),
    ("　B3F  B4-3a (50x70) ", "B3F B4-3a"),
    ("RFCB1（40×60）", "RF CB1"),
    ("(40X60)", "40x60"),
    ("40 * 60", "40 * 60"),
    ("B4FFB3-2", "B4F FB3-2"),
    ("6#11", "6-#11"),
    ("-11#4", "-11-#4"),
    ("-1#4", "-1#4"),
    ("12-#5(e.f)", "12-#5 (E.F.)"),
    ("12-#5_(ef)", "12-#5 (E.F.)"),
    ("B1 (重複-2)", "B1"),
    ("e.f", "E.F."),
    ("EF", "E.F."),
    ("BOX", "BOx"),
]


def test_normalize_text(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", X.normalize_text(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[1] for c in CASES]


@pytest.mark.parametrize(
    ("items", "want"),
    [
        (None, []),
        ([], []),
        (["E.F", "4-#5", "", None, "12-#3", "4-#5"], ["12-#3", "4-#5", "E.F."]),
        (["b", "a", "3-#2", "x"], ["3-#2", "b", "a", "x"]),
    ],
)
def test_normalize_list(spark, items, want):
    df = spark.createDataFrame([(items,)], "l array<string>")
    assert df.select(X.normalize_list(F.col("l"))).first()[0] == want


def test_candidates_and_ids(spark):
    texts = ["B1", "x", "@B", "a#", "4x5", "12", "Bà"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.where(X.is_title_candidate(F.col("t"))).collect()] == ["B1", "4x5", "Bà"]
    df = spark.createDataFrame([("see [1, 2, 5] ok",), ("none",), ("] [",), ("[]",), (None,)], "t string")
    assert [r[0] for r in df.select(X.id_list(F.col("t"))).collect()] == [[1, 2, 5], None, None, [], None]


def test_normalize_struct(spark):
    df = spark.sql("select named_struct('a', 'B1 (3x4)', 'b', array('6#11'), 'c', array(array('6#11')), 'd', named_struct('e', 'EF'), 'f', 2) as r")
    got = df.select(X.normalize_struct(F.col("r"), df.schema["r"].dataType).alias("r")).first().r.asDict(True)
    assert got == {"a": "B1", "b": ["6-#11"], "c": [["6#11"]], "d": {"e": "E.F."}, "f": 2}


def test_fixed_rounds_the_binary_value(spark):
    from pyspark.sql import functions as F

    values = [0.0, 1.0, 0.7278125, 0.0003125, 0.1234565, 0.9999995, 0.5, 1 / 3, 0.25, 2.5e-7, 5e-7, 1e-9, 1234.5678125, *(k / 9600 for k in range(1, 2000, 7)), *(k / 128 for k in range(128))]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.fixed(F.col("v"), 6).alias("six"), X.fixed(F.col("v"), 1).alias("one")).collect()
    assert [(r.six, r.one) for r in got] == [(f"{v:.6f}", f"{v:.1f}") for v in values]
