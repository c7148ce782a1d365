"""Every registered page query with SQL gives the SQL's rows; the others run."""

import duckdb
import pytest

from planforge.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    rel = db.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    want = rel.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert plain(tuple(r) for r in df.select(columns).collect()) == plain(want)


def test_pipeline_blocks_hold_their_titles(spark):
    from planforge.sources.fixtures import Pages

    got = catalog.queries()["pipeline_blocks"](spark, SF).collect()
    assert got
    p = Pages(spark, SF)
    at = {(r.page_id, r.title_id): (r.cx_px / 4, r.cy_px / 4) for r in p.titles.collect()}
    seen = set()
    for r in got:
        for t in map(int, r.titles.split("|")):
            x, y = at[r.page_id, t]
            assert r.x0 - 10 <= x <= r.x1 + 10
            assert r.y0 - 5 <= y <= r.y1 + 10
            assert (r.page_id, t) not in seen
            seen.add((r.page_id, t))


def test_pipeline_blocks_by_groups_of_pages(spark, monkeypatch, tmp_path):
    """Groups of pages give the rows of all pages together; of each only the result stays on disk, and the session keeps its settings."""
    context = spark.sparkContext
    names = ("spark.sql.adaptive.enabled", "spark.sql.requireAllClusterKeysForCoPartition")
    before = context.getCheckpointDir(), [spark.conf.get(n) for n in names]
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    got = []
    try:
        for parts in (1, 2):
            context.setCheckpointDir(f"{tmp_path}/{parts}")
            monkeypatch.setattr(catalog, "PART_ROWS", -(-rows // parts), raising=False)
            got.append(sorted(map(tuple, catalog.queries()["pipeline_blocks"](spark, SF).collect())))
            assert len(list((tmp_path / str(parts)).glob("*/rdd-*"))) == parts
    finally:
        if before[0]:
            context.setCheckpointDir(before[0].removeprefix("file:").rpartition("/")[0])
    assert got[0] == got[1] != []
    assert [spark.conf.get(n) for n in names] == before[1]
