"""Folds, runs and components against plain loops, on random pages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from planforge.config import Config
from planforge.operators import export, folds, rows, runs, titles

BOXES = "page_id long, block_id int, x0 double, y0 double, x1 double, y1 double"
DIMS = "page_id long, page_w double, page_h double"


@pytest.fixture(scope="module")
def boxes():
    r = random.Random(4)
    out = []
    for page in range(6):
        for i in range(25):
            x, y = r.randrange(600) / 4, r.randrange(600) / 4
            out.append((page, i, x, y, x + r.randrange(40, 400) / 4, y + r.randrange(30, 300) / 4))
    return out


def inter(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def area(a):
    return (a[2] - a[0]) * (a[3] - a[1])


def united(a, b):
    return [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]


def test_nms(spark, boxes):
    got = folds.nms_keep(spark.createDataFrame(boxes, BOXES)).collect()
    want = {}
    for page in range(6):
        kept = []
        for b in sorted((b for b in boxes if b[0] == page), key=lambda b: (-area(b[2:]), b[1])):
            box = list(b[2:])
            for k in kept:
                if inter(k[1], box) / (area(box) + 1e-6) > 0.4:
                    k[1] = united(k[1], box)
                    break
            else:
                kept.append([b[1], box])
        want |= {(page, i): (k[0], *k[1]) for i, k in enumerate(kept)}
    assert {(r.page_id, r.keep): (r.block_id, r.x0, r.y0, r.x1, r.y1) for r in got} == want


def test_dedup(spark, boxes):
    bridge = [(b[0], b[1], b[1] % 7) for b in boxes] + [(b[0], b[1], b[1] % 5) for b in boxes if b[1] % 5 != b[1] % 7]
    got = folds.block_dedup(spark.createDataFrame(boxes, BOXES), spark.createDataFrame(bridge, "page_id long, block_id int, title_id int")).collect()
    want = {}
    for page in range(6):
        kept = []
        for b in (b for b in boxes if b[0] == page):
            box, own = list(b[2:]), sorted({b[1] % 7, b[1] % 5})
            for k in kept:
                if inter(k[0], box) / (min(area(k[0]), area(box)) + 1e-6) > 0.6:
                    k[0] = united(k[0], box)
                    k[1] += [t for t in own if t not in k[1]]
                    break
            else:
                kept.append([box, own])
        want |= {(page, i): (*k[0], k[1]) for i, k in enumerate(kept)}
    assert {(r.page_id, r.idx): (r.x0, r.y0, r.x1, r.y1, r.titles) for r in got} == want


def test_title_merge(spark):
    row = lambda seq, text, left, cy: (0, 0, seq, text, left * 4 + 50.0, cy, cy + 12, 24.0, 100.0, left, left + 25.0)
    rows_ = [row(0, "B1F", 0.0, 100.0), row(1, "G2", 60.0, 110.0), row(2, "(40x60)", 90.0, 120.0), row(3, "(30x50)", 100.0, 120.0), row(4, "far", 400.0, 120.0)]
    df = spark.createDataFrame(rows_, "page_id long, window_id int, seq int, text string, cx_px double, cy_px double, bottom_px double, h_px double, w_px double, left_pt double, right_pt double")
    got = folds.title_merge(df).orderBy("part").collect()
    assert [r.text for r in got] == ["B1F G2 (40x60)", "(30x50)", "far"]
    assert (got[0].left_pt, got[0].right_pt, got[0].cy_px) == (0.0, 115.0, 112.5)


def test_vertical_split_by_hand(spark):
    b = spark.createDataFrame([(0, 0, 0.0, 0.0, 50.0, 100.0)], BOXES)
    t = [(0, 0, 0, 100.0, 40.0, 0.0, 20.0), (0, 0, 1, 160.0, 160.0, 5.0, 25.0), (0, 0, 2, 221.0, 176.0, 5.0, 25.0)]
    t = spark.createDataFrame(t, "page_id long, block_id int, title_id int, cy_px double, bottom_px double, left_pt double, right_pt double")
    # A gap of exactly 60 px is the same row.
    assert [r.row for r in rows.y_groups(t).orderBy("title_id").collect()] == [0, 0, 1]
    got = rows.vertical_split(b, t).orderBy("part").collect()
    assert [(r.y0, r.y1) for r in got] == [(0.0, 41.0), (45.0, 46.0)]


@pytest.fixture(scope="module")
def ink():
    """Dense masks of three pages and their runs."""
    rng = np.random.default_rng(3)
    masks, out = [], []
    for page in range(3):
        mask = np.zeros((240, 320), bool)
        for _ in range(14):
            y, x = rng.integers(0, 220), rng.integers(0, 280)
            mask[y : y + rng.integers(1, 12), x : x + rng.integers(2, 60)] = True
        masks.append(mask)
        for y in range(240):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
            out += [(page, y, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return masks, out


RUNS = "page_id long, y int, x_start int, x_end int"
PAGES = [(p, 80.0, 60.0) for p in range(3)]


def dense(rows_, shape=(240, 320)):
    out = np.zeros((3, *shape), bool)
    for r in rows_:
        assert not out[r.page_id, r.y, r.x_start : r.x_end].any()
        out[r.page_id, r.y, r.x_start : r.x_end] = True
    return out


def test_trim_and_split(spark, ink):
    masks, run = ink
    r = random.Random(8)
    b = []
    for p in range(3):
        for i in range(12):
            x, y = r.randrange(-8, 200) / 4, r.randrange(-8, 160) / 4
            b.append((p, i, x, y, x + r.randrange(60, 200) / 4, y + r.randrange(8, 120) / 4))
    df, dims, ink_df = spark.createDataFrame(b, BOXES), spark.createDataFrame(PAGES, DIMS), spark.createDataFrame(run, RUNS)
    got = {(x.page_id, x.block_id): (x.x0, x.y0, x.x1, x.y1) for x in runs.content_trim(df, dims, ink_df, 6, 2, bottom=True).collect()}
    for p, i, x0, y0, x1, y1 in b:
        x0, y0, x1, y1 = max(0.0, x0), max(0.0, y0), min(80.0, x1), min(60.0, y1)
        a, t, e, o = max(0, int(x0 * 4)), max(0, int(y0 * 4)), min(320, int(x1 * 4)), min(240, int(y1 * 4))
        roi = masks[p][t:o, a:e]
        if roi.size and roi.any():
            c, w = np.flatnonzero(roi.any(0)), np.flatnonzero(roi.any(1))
            x0, x1 = (a + max(0, c[0] - 6)) / 4, (a + min(e - a - 1, c[-1] + 6)) / 4
            y0, y1 = (t + max(0, w[0] - 2)) / 4, (t + min(o - t - 1, w[-1] + 2)) / 4
        assert got[p, i] == (x0, y0, x1, y1)
    got = {}
    for x in runs.x_split(df, dims, ink_df, Config(split_min_pt=5.0)).orderBy("part").collect():
        got.setdefault((x.page_id, x.block_id), []).append((x.x0, x.x1))
    for p, i, x0, y0, x1, y1 in b:
        a, t, e, o = max(0, int(x0 * 4)), max(0, int(y0 * 4)), min(320, int(x1 * 4)), min(240, int(y1 * 4))
        want = [(x0, x1)]
        if e - a >= 100 and o - t >= 20:
            blank = ~masks[p][t:o, a:e].any(0)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], blank.astype(np.int8), [0]])))
            gaps = [(s, z) for s, z in zip(edge[::2], edge[1::2], strict=True) if z - s >= 3]
            if gaps:
                cuts, at = [], 0
                for s, z in gaps:
                    if s > at:
                        cuts.append((x0 + at / 4, x0 + s / 4))
                    at = z
                if at < e - a:
                    cuts.append((x0 + at / 4, x1))
                want = [c for c in cuts if c[1] - c[0] > 5]
        assert got.get((p, i), []) == want


def test_mask_dilate_and_recovery(spark, ink):
    masks, run = ink
    dims, ink_df = spark.createDataFrame(PAGES, DIMS), spark.createDataFrame(run, RUNS)
    t = [(0, 0, 10.0, 22.0, 60.0, 24.0), (0, 1, 15.0, 30.0, 70.0, 24.0), (1, 0, 0.0, 80.0, 100.0, 100.0)]
    tdf = spark.createDataFrame(t, "page_id long, title_id int, left_pt double, right_pt double, bottom_px double, h_px double")
    want = np.array(masks)
    for p, _, a, b, low, h in t:
        want[p, max(0, int(low - h) - 8) : min(240, int(low) + 8), max(0, int(a * 4) - 8) : min(320, int(b * 4) + 8)] = False
    assert (dense(runs.title_mask(ink_df, tdf, dims).collect()) == want).all()
    grown = np.zeros_like(want)
    for p, y, x in zip(*np.nonzero(np.array(masks)), strict=True):
        grown[p, max(0, y - 14) : y + 15, max(0, x - 14) : x + 15] = True
    assert (dense(runs.dilate(ink_df, dims).collect()) == grown).all()
    b = [(p, i, float(5 * i), float(4 + 3 * i), float(5 * i + 20), 60.0) for p in range(3) for i in range(12)]
    got = {(x.page_id, x.block_id): x.y0 for x in runs.top_recovery(spark.createDataFrame(b, BOXES), dims, ink_df).collect()}
    for p, i, x0, y0, x1, _ in b:
        a, e, y = int(x0 * 4), min(320, int(x1 * 4)), int(y0 * 4)
        n = 0
        while y > 0 and n < 200 and masks[p][y, a:e].any():
            y, n = y - 1, n + 1
        assert got[p, i] == (y / 4 if n else y0)


def flood(mask, diagonal):
    seen, out = np.zeros_like(mask), []
    h, w = mask.shape
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        todo, cells = [(y, x)], []
        seen[y, x] = True
        while todo:
            c = todo.pop()
            cells.append(c)
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (dy or dx) and (diagonal or not (dy and dx)):
                        q = c[0] + dy, c[1] + dx
                        if 0 <= q[0] < h and 0 <= q[1] < w and mask[q] and not seen[q]:
                            seen[q] = True
                            todo.append(q)
        ys, xs = [c[0] for c in cells], [c[1] for c in cells]
        out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1))
    return out


def test_components(spark, ink):
    masks, run = ink
    extra = [(0, y, 100, 101) for y in range(225, 235)] + [(0, y, 140, 141) for y in range(225, 235)] + [(0, 225, 100, 141), (0, 234, 100, 141)]
    got = runs.components(spark.createDataFrame(run + extra, RUNS)).collect()
    for p in range(3):
        mask = masks[p].copy()
        for q, y, a, b in extra:
            if q == p:
                mask[y, a:b] = True
        outer = sorted(flood(mask, True))
        assert sorted((r.x, r.y, r.x + r.w, r.y + r.h) for r in got if r.page_id == p and r.kind == "outer") == outer
        around = np.pad(~mask, 1, constant_values=True)
        holes = sorted((a - 2, t - 2, b, e) for a, t, b, e in flood(around, False) if (a, t) != (0, 0))
        assert sorted((r.x, r.y, r.x + r.w, r.y + r.h) for r in got if r.page_id == p and r.kind == "hole") == holes


def test_threshold_lines_and_erase(spark):
    px = spark.createDataFrame([(0, 3, [10, 150, 151, 255, 0]), (0, 4, [200] * 5)], "page_id long, y int, pixels array<int>")
    assert sorted(tuple(r) for r in runs.threshold_runs(px).select("page_id", "y", "x_start", "x_end").collect()) == [(0, 3, 0, 2), (0, 3, 4, 5)]
    dims = spark.createDataFrame([(0, 100.0, 50.0)], DIMS)
    r = spark.createDataFrame([(0, 40, 5, 200), (0, 40, 290, 396), (0, 45, 10, 30), (0, 90, 10, 30)], RUNS)
    lines = runs.long_lines(r, dims).collect()
    assert [(x.y, x.x_start, x.x_end) for x in lines] == [(40, 5, 396)]
    assert [(x.y, x.x_start, x.x_end) for x in runs.erased(r, dims).collect()] == [(90, 10, 30)]


def test_argmin_ties_and_borders(spark):
    b = spark.createDataFrame([(0, 0, 0.0, 0.0, 10.0, 10.0), (0, 1, 0.0, 0.0, 10.0, 10.0), (0, 2, 0.0, 0.0, 20.0, 10.0)], BOXES)
    t = spark.createDataFrame([(0, 0, 20.0, 20.0), (0, 1, 80.0, 80.0), (0, 2, 80.25, 20.0), (0, 3, 200.0, 20.0)], "page_id long, title_id int, cx_px double, cy_px double")
    got = {r.title_id: r.block_id for r in titles.argmin_assign(b, t).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_label_files(spark):
    dims = spark.createDataFrame([(0, 100.0, 50.0), (1, 100.0, 50.0), (2, 0.0, 50.0)], DIMS)
    b = spark.createDataFrame([(0, 0, 10.0, 10.0, 30.0, 20.0), (0, 1, -10.0, 0.0, 120.0, 60.0), (2, 0, 0.0, 0.0, 1.0, 1.0)], BOXES)
    got = {r.page_id: r.content for r in export.label_files(export.yolo_labels(b, dims), dims).collect()}
    assert got == {0: "0 0.200000 0.300000 0.200000 0.200000\n0 0.550000 0.600000 1.000000 1.000000", 1: "", 2: ""}


def test_export_of_page_without_blocks(spark):
    dims = spark.createDataFrame([(0, 100.0, 50.0)], DIMS)
    none = spark.createDataFrame([], BOXES)
    t = spark.createDataFrame([], "page_id long, title_id int, text string, cx_px double, cy_px double, w_px double, h_px double")
    got = export.beam_export(none, spark.createDataFrame([], "page_id long, block_id int, title_id int"), t, dims).select(F.to_json("page_info"), F.size("continuous_beams")).first()
    assert tuple(got) == ('{"page_num":0,"width":100.0,"height":50.0}', 0)
