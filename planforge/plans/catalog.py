"""The registered page queries, each with the SQL that gives the same rows.

Where there is no SQL (the merge of title tokens, components, the whole pipeline), tests hold the query against a
brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planforge.config import Config
from planforge.functions import text as X
from planforge.functions.rect import Rect
from planforge.operators import blocks as B
from planforge.operators import export as E
from planforge.operators import folds as G
from planforge.operators import heuristic as H
from planforge.operators import rows as R
from planforge.operators import runs as I
from planforge.operators import titles as J
from planforge.plans.pipeline import full_pipeline
from planforge.sources.fixtures import Pages, with_fixtures

#: Rows of lineitem whose pages go through the pipeline together.
PART_ROWS = 6_000_000

QUERIES: dict[str, Callable[[Pages], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[Pages], DataFrame]):
        name = f.__name__
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else F.col(f.name) for f in df.schema.fields))


def run(f: Callable[[Pages], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: longs(f(Pages(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_fixtures(sql) for name, sql in ORACLES.items()}


def joined(column: str):
    return F.array_join(F.col(column).cast("array<string>"), "|")


TITLE = r"regexp_matches(trim(text), '[a-zA-Z0-9_-]+') and regexp_matches(trim(text), '\([0-9]+[xX*][0-9]+\)')"
DIM = r"\d+[\s\p{Z}]*[xX×*][\s\p{Z}]*\d+"
STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
VALID = f"select page_id, title_id, cx_px, cy_px, bottom_px, h_px, w_px, left_pt, right_pt, text from titles where regexp_matches(text, '{DIM}')"


def valid(p: Pages) -> DataFrame:
    return J.valid_titles(p.titles)


# Heuristic extraction


@query(f"select page_id, cast(block_no as bigint) as block_no, trim(text) as text, x0, y0, x1, y1 from text_blocks where block_type = 0 and {TITLE}")
def heuristic_titles(p: Pages) -> DataFrame:
    return H.heuristic_titles(p.text_blocks)


@query(f"""with t as (
  select page_id, block_no, trim(text) as beam_id, x0, y0, x1, y1, case when (x1-x0)*6 > 300 then (x1-x0)*6 else 300.0 end as high from text_blocks where block_type = 0 and {TITLE}),
u as (select t.page_id, t.block_no, t.beam_id, t.x0, t.y0, t.x1, t.y1, t.high, min(v.x0) as ux0, min(v.y0) as uy0, max(v.x1) as ux1, max(v.y1) as uy1
  from t left join vectors v on v.page_id = t.page_id and v.x0 < v.x1 and v.y0 < v.y1
   and v.x0 < t.x1 + (t.x1-t.x0)*2.5 and v.x1 > t.x0 - (t.x1-t.x0)*2.5 and v.y0 < t.y1 + 20 and v.y1 > t.y0 - t.high
  group by all)
select page_id, cast(block_no as bigint) as block_no, beam_id, x0, y0, x1, y1,
  case when ux0 is null then x0 - (x1-x0)*2.5 else least(ux0, x0) end - 15 as bx0,
  case when ux0 is null then y0 - high when uy1 - uy0 > high*1.5 then y0 - high else least(uy0, y0) end - 15 as by0,
  case when ux0 is null then x1 + (x1-x0)*2.5 else greatest(ux1, x1) end + 15 as bx1,
  case when ux0 is null then y1 + 20 else greatest(uy1, y1) end + 15 as by1 from u""")
def heuristic_boxes(p: Pages) -> DataFrame:
    return H.heuristic_boxes(p.text_blocks, p.vectors)


@query("""with t as (select page_id, count(*) as n_texts, string_agg(trim(text), '|' order by block_no) as texts from text_blocks where block_type = 0 and trim(text) <> '' group by page_id),
v as (select page_id, count(*) as n_vectors, string_agg(cast(vec_seq as varchar), ',' order by vec_seq) filter (where r <= 50) as first_vectors
  from (select *, row_number() over (partition by page_id order by vec_seq) as r from vectors) group by page_id)
select page_id, page_w, page_h, coalesce(n_texts, 0) as n_texts, coalesce(n_vectors, 0) as n_vectors, texts, first_vectors from page_dims left join t using (page_id) left join v using (page_id)""")
def page_summary(p: Pages) -> DataFrame:
    return H.page_summary(p.page_dims, p.text_blocks, p.vectors)


# Text


def normal_sql(column: str) -> str:
    """The normaliser in SQL; `\\s` as [\\s\\p{Z}], and no lookbehind."""
    s = r"[\s\p{Z}]"
    t = f"regexp_replace(translate({STRIP.format(column)}, '（）×ＸX', '()xxx'), '{s}+', ' ', 'g')"
    pure = rf"regexp_matches({t}, '^{s}*\(?{s}*\d+{s}*[xX*]{s}*\d+{s}*\)?{s}*$')"
    plain = STRIP.format(rf"regexp_replace({t}, '{s}*\({s}*\d+{s}*[xX*]{s}*\d+{s}*\)', '', 'g')")
    t = f"case when {pure} then {STRIP.format(f"translate({t}, '()', '')")} else {plain} end"
    for a, b in (
        (r"((?:R|B?\d+)[Ff])([A-Za-z])", r"\1 \2"),
        (rf"\({s}*[Ee]\.?[Ff]\.?{s}*\)", "(E.F.)"),
        (r"([^\s\p{Z}])\(E\.F\.\)", r"\1 (E.F.)"),
        (rf"_{s}*\(E\.F\.\)", " (E.F.)"),
        (rf"(^|[^-])(\d+){s}*(#\d+)", r"\1\2-\3"),
        (rf"{s}*\(重複-\d+\){s}*$", ""),
    ):
        t = f"regexp_replace({t}, '{a}', '{b}', 'g')"
    return f"case when {column} is null or {column} in ('LLM沒有東西', 'LLM看不出來') then '' when ({t}) in ('e.f', 'ef', 'E.F', 'EF') then 'E.F.' else {t} end"


@query(f"select page_id, cast(title_id as bigint) as title_id, {normal_sql('text')} as text from titles")
def normalize_text(p: Pages) -> DataFrame:
    return p.titles.select("page_id", "title_id", X.normalize_text(F.col("text")).alias("text"))


@query(f"""select page_id, cast(title_id as bigint) as title_id, text from titles
where length({STRIP.format("text")}) >= 2 and not regexp_matches(text, '[@#]') and (regexp_matches(text, '{DIM}') or regexp_matches(text, '[A-Za-z]'))""")
def title_candidates(p: Pages) -> DataFrame:
    return p.titles.where(X.is_title_candidate(F.col("text"))).select("page_id", "title_id", "text")


@query(f"select page_id, cast(title_id as bigint) as title_id, text from titles where regexp_matches(text, '{DIM}')")
def dimension_filter(p: Pages) -> DataFrame:
    return p.titles.where(X.has_dimension(F.col("text"))).select("page_id", "title_id", "text")


@query(f"select page_id, cast(title_id as bigint) as title_id, cast(len(regexp_extract_all(text || ' / ' || text, '{DIM}')) as bigint) as n from titles")
def dimension_count(p: Pages) -> DataFrame:
    twice = F.concat("text", F.lit(" / "), "text")
    return p.titles.select("page_id", "title_id", X.dimension_count(twice).alias("n"))


@query(f"""with n as (select list_id, pos, {normal_sql("item")} as item from rebar_items where item <> ''),
f as (select list_id, item, min(pos) as pos from n where item <> '' group by list_id, item),
k as (select *, case when regexp_matches(item, '^\\d+-#') then -cast(regexp_extract(item, '^(\\d+)-#', 1) as bigint) else 0 end as key from f),
l as (select list_id, string_agg(item, '|' order by key, pos) as items from k group by list_id)
select i.list_id, coalesce(l.items, '') as items from (select distinct list_id from rebar_items) i left join l using (list_id)""")
def normalize_list(p: Pages) -> DataFrame:
    lists = p.rebar_items.groupBy("list_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items"))
    return lists.select("list_id", F.array_join(X.normalize_list(F.col("items")), "|").alias("items"))


@query(f"""select page_id, cast(title_id as bigint) as title_id, {normal_sql("text")} as name, {normal_sql("t2")} || '|' || {normal_sql("t3")} as inner_list, t2 as nested, w_px as width
from (select *, '(' || title_id || 'x20)' as t2, 'FB' || title_id || ' (ef)' as t3 from titles)""")
def normalize_dict(p: Pages) -> DataFrame:
    two, three = F.concat(F.lit("("), F.col("title_id").cast("string"), F.lit("x20)")), F.concat(F.lit("FB"), F.col("title_id").cast("string"), F.lit(" (ef)"))
    rec = F.struct(F.col("text").alias("name"), F.struct(F.array(two, three).alias("items")).alias("inner"), F.array(F.array(two)).alias("nested"), F.col("w_px").alias("width"))
    d = p.titles.select("page_id", "title_id", rec.alias("rec"))
    d = d.withColumn("rec", X.normalize_struct(F.col("rec"), d.schema["rec"].dataType))
    return d.select("page_id", "title_id", "rec.name", F.array_join("rec.inner.items", "|").alias("inner_list"), F.col("rec.nested")[0][0].alias("nested"), "rec.width")


@query("select page_id, title_id from (select distinct page_id, cast(title_id as bigint) as title_id from titles)")
def id_list_decode(p: Pages) -> DataFrame:
    """The answer of a classifier is put together for each page and read again."""
    ids = F.array_join(F.collect_list(F.col("title_id").cast("string")), ", ")
    a = p.titles.groupBy("page_id").agg(F.concat(F.lit("The titles are: ["), ids, F.lit("]. Done.")).alias("answer"))
    return a.select("page_id", F.explode(X.id_list(F.col("answer"))).alias("title_id")).distinct()


# Export


@query("""select page_id, cast(title_id as bigint) as title_id, text, round((cx_px - w_px/2)/4, 2) as x0, round((cy_px - h_px/2)/4, 2) as y0,
 round((cx_px + w_px/2)/4, 2) as x1, round((cy_px + h_px/2)/4, 2) as y1 from titles""")
def title_boxes(p: Pages) -> DataFrame:
    return E.title_boxes(p.titles)


YOLO = """select page_id, cast(block_id as bigint) as parent_id, cast(0 as bigint) as class_id, greatest(0.0, least(1.0, (x0+x1)/2/page_w)) as cx, greatest(0.0, least(1.0, (y0+y1)/2/page_h)) as cy,
 greatest(0.0, least(1.0, (x1-x0)/page_w)) as w, greatest(0.0, least(1.0, (y1-y0)/page_h)) as h from blocks join page_dims using (page_id) where page_w > 0 and page_h > 0"""


@query(YOLO)
def yolo_labels(p: Pages) -> DataFrame:
    return E.yolo_labels(p.blocks, p.page_dims)


@query(f"with l as ({YOLO}) select page_id, coalesce(string_agg(printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w, h), chr(10) order by parent_id), '') as content from page_dims left join l using (page_id) group by page_id")
def label_files(p: Pages) -> DataFrame:
    return E.label_files(E.yolo_labels(p.blocks, p.page_dims), p.page_dims).select("page_id", "content")


@query("""with a as (select t.page_id, t.title_id, arg_min(b.block_id, row((b.x1-b.x0)*(b.y1-b.y0), b.block_id)) as block_id from titles t join blocks b
 on b.page_id = t.page_id and t.cx_px/4 between b.x0-10 and b.x1+10 and t.cy_px/4 between b.y0-5 and b.y1+10 group by all),
x as (select a.page_id, a.block_id, string_agg(t.text || '@' || cast(round((t.cx_px - t.w_px/2)/4, 2) as varchar), ';' order by t.title_id) as titles, count(*) as n_titles
 from a join titles t on a.page_id = t.page_id and a.title_id = t.title_id group by all)
select b.page_id, cast(b.block_id as bigint) as parent_id, b.x0, b.y0, b.x1, b.y1, coalesce(x.titles, '') as titles, coalesce(n_titles, 0) as n_titles, b.x0 as span_x0, d.page_w as width
from blocks b join page_dims d using (page_id) left join x on b.page_id = x.page_id and b.block_id = x.block_id""")
def beam_export(p: Pages) -> DataFrame:
    """The nested records, unfolded again."""
    e = E.beam_export(p.blocks, J.argmin_assign(p.blocks, p.titles), p.titles, p.page_dims)
    b = e.select("page_id", "page_info", F.explode("continuous_beams").alias("b"))
    text = F.array_join(F.transform("b.titles", lambda t: F.concat(t["text"], F.lit("@"), t["bbox"][0].cast("string"))), ";")
    box = F.col("b.parent_bbox")
    return b.select("page_id", "b.parent_id", *(box[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))), text.alias("titles"), F.size("b.titles").cast("long").alias("n_titles"), F.col("b.single_spans")[0][0].alias("span_x0"), F.col("page_info.width").alias("width"))


@query("""with s as (select page_id, block_id - block_id % 3 as parent, block_id, x0, y0 from blocks where y0 < 300)
select b.page_id, cast(b.block_id as bigint) as block_id, cast(coalesce(n, 1) as bigint) as n_spans, coalesce(first_x0, b.x0) as first_x0 from blocks b
left join (select page_id, parent, count(*) as n, arg_min(x0, block_id) as first_x0 from s group by all) g on g.page_id = b.page_id and g.parent = b.block_id""")
def default_spans(p: Pages) -> DataFrame:
    s = p.blocks.where("y0 < 300").select("page_id", (F.col("block_id") - F.col("block_id") % 3).alias("block_id"), F.col("block_id").alias("span_id"), "x0", "y0", "x1", "y1")
    out = E.spans_of(p.blocks, s)
    return out.select("page_id", "block_id", F.size("spans").cast("long").alias("n_spans"), F.col("spans")[0][0].alias("first_x0"))


@query("""with a as (select t.page_id, t.title_id, arg_min(b.block_id, row((b.x1-b.x0)*(b.y1-b.y0), b.block_id)) as block_id from titles t join blocks b
 on b.page_id = t.page_id and t.cx_px/4 between b.x0-10 and b.x1+10 and t.cy_px/4 between b.y0-5 and b.y1+10 group by all),
x as (select a.page_id, a.block_id, count(*) as n, string_agg(printf('%s (X=%.1f, Y=%.1f)', t.text, t.cx_px, t.cy_px), '; ' order by t.title_id) as titles from a join titles t on a.page_id = t.page_id and a.title_id = t.title_id group by all)
select b.page_id, cast(b.block_id as bigint) as block_id, coalesce(n, 0) as n, coalesce(titles, '') as titles from blocks b left join x on x.page_id = b.page_id and x.block_id = b.block_id""")
def title_summary(p: Pages) -> DataFrame:
    return E.title_summary(p.blocks, J.argmin_assign(p.blocks, p.titles), p.titles)


# Blocks

SIZED = "select c.*, page_w, page_h, cast(w as double)*h as area, page_w*4*page_h*4*0.25 as most from components c join page_dims using (page_id)"


@query(f"""with s as ({SIZED}) select page_id, cast(comp_id as bigint) as block_id, greatest(0.0, (x-40)/4.0::double) as x0, greatest(0.0, (y-40)/4.0::double) as y0,
 least(page_w, (x+w+40)/4.0::double) as x1, least(page_h, (y+h+160)/4.0::double) as y1 from s where area > 3000 and area < most""")
def block_filter(p: Pages) -> DataFrame:
    return B.block_filter(p.components, p.page_dims)


@query(f"""with s as ({SIZED}) select page_id, cast(comp_id as bigint) as comp_id, case when area >= most then 'oversize' else 'noise' end as reason, greatest(0.0, (x-10)/4.0::double) as x0, greatest(0.0, (y-10)/4.0::double) as y0,
 least(page_w, (x+w+10)/4.0::double) as x1, least(page_h, (y+h+10)/4.0::double) as y1 from s where not (area > 3000 and area < most) and (area >= most or area > 4000)""")
def drop_reasons(p: Pages) -> DataFrame:
    return B.dropped_blocks(p.components, p.page_dims)


@query("""select page_id, cast(block_id as bigint) as block_id, greatest(0.0, x0-10) as x0, greatest(0.0, y0-10) as y0, least(page_w, x1+10) as x1, least(page_h, y1+40) as y1 from blocks join page_dims using (page_id)""")
def expand_clamp(p: Pages) -> DataFrame:
    g = Rect.of().grown(10, 10, 10, 40)
    box = Rect(F.greatest(F.lit(0.0), g.x0), F.greatest(F.lit(0.0), g.y0), F.least("page_w", g.x1), F.least("page_h", g.y1))
    return p.blocks.join(p.page_dims, "page_id").select("page_id", "block_id", *box.named())


@query("""select a.page_id, cast(a.block_id as bigint) as a_id, cast(b.block_id as bigint) as b_id, (least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0)) as inter,
 least(a.x0,b.x0) as ux0, least(a.y0,b.y0) as uy0, greatest(a.x1,b.x1) as ux1, greatest(a.y1,b.y1) as uy1,
 (least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0)) / (least((a.x1-a.x0)*(a.y1-a.y0), (b.x1-b.x0)*(b.y1-b.y0)) + 1e-6) > 0.6 as same
from blocks a join blocks b on a.page_id = b.page_id and a.block_id < b.block_id and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1""")
def rect_algebra(p: Pages) -> DataFrame:
    return B.overlaps(p.blocks)


@query("select page_id, cast(block_id as bigint) as block_id, row_number() over (partition by page_id order by y0, x0, block_id) - 1 as seq from blocks")
def reading_order(p: Pages) -> DataFrame:
    return B.reading_order(p.blocks).select("page_id", "block_id", "seq")


@query("select page_id, cast(block_id as bigint) as block_id, row_number() over (partition by page_id order by (x1-x0)*(y1-y0) desc, block_id) - 1 as seq from blocks")
def area_order(p: Pages) -> DataFrame:
    return B.by_area(p.blocks).select("page_id", "block_id", "seq")


@query(f"""with s as ({SIZED}), m as (select page_id, count(*) as total_contours, count(*) filter (where not (area > 3000 and area < most)) as noise_dropped, count(*) filter (where area > 3000 and area < most) as parent_count from s group by page_id)
select page_id, coalesce(total_contours, 0) as total_contours, coalesce(noise_dropped, 0) as noise_dropped, coalesce(parent_count, 0) as parent_count, coalesce(round(noise_dropped / nullif(total_contours, 0) * 100, 1), 0.0) as noise_drop_rate from page_dims left join m using (page_id)""")
def page_metrics(p: Pages) -> DataFrame:
    return B.page_metrics(p.components, p.page_dims).select("page_id", "total_contours", "noise_dropped", "parent_count", "noise_drop_rate")


# Folds


NMS = """with recursive o as (select page_id, block_id, x0, y0, x1, y1, row_number() over (partition by page_id order by (x1-x0)*(y1-y0) desc, block_id) as r from blocks),
t as (select page_id, r, [{'id': block_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'took': []::int[]}] as kept from o where r = 1
 union all select page_id, r, case when spot is null or spot = 0 then list_append(kept, {'id': block_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'took': []::int[]})
  else list_transform(kept, lambda k, i: case when i = spot then {'id': k.id, 'x0': least(k.x0, x0), 'y0': least(k.y0, y0), 'x1': greatest(k.x1, x1), 'y1': greatest(k.y1, y1), 'took': list_append(k.took, block_id)} else k end) end
 from (select o.*, kept, list_position(list_transform(kept, lambda k: greatest(0, least(k.x1, o.x1) - greatest(k.x0, o.x0)) * greatest(0, least(k.y1, o.y1) - greatest(k.y0, o.y0)) / ((o.x1-o.x0)*(o.y1-o.y0) + 1e-6) > 0.4), true) as spot
  from t join o on o.page_id = t.page_id and o.r = t.r + 1)),
kept as (select page_id, unnest(kept) as k, unnest(range(len(kept))) as keep from (select page_id, arg_max(kept, r) as kept from t group by page_id))"""


@query(f"{NMS} select page_id, keep, cast(k.id as bigint) as block_id, k.x0 as x0, k.y0 as y0, k.x1 as x1, k.y1 as y1 from kept")
def nms_keep(p: Pages) -> DataFrame:
    return G.nms_keep(p.blocks).drop("took")


@query(f"{NMS} select page_id, cast(k.id as bigint) as into_id, cast(unnest(k.took) as bigint) as block_id from kept")
def nms_drops(p: Pages) -> DataFrame:
    return G.nms_drops(p.blocks)


@query()
def title_merge(p: Pages) -> DataFrame:
    return G.title_merge(J.ocr_geometry(p.ocr_tokens))


@query()
def block_dedup(p: Pages) -> DataFrame:
    return G.block_dedup(p.blocks, J.argmin_assign(p.blocks, valid(p))).withColumn("titles", joined("titles"))


# Titles

OCR = f"""select page_id, window_id, seq, text, (ax+bx+bx+ax)/4 as cx_px, (ay+ay+by_+by_)/4 as cy_px, by_ as bottom_px, by_-ay as h_px, bx-ax as w_px, ax/4 as left_pt, bx/4 as right_pt
from ocr_tokens where conf > 0.5 and length(trim(text)) >= 2 and not regexp_matches(text, '[@#]') and (regexp_matches(text, '{DIM}') or regexp_matches(text, '[A-Za-z]'))"""


@query(f"select page_id, cast(window_id as bigint) as window_id, cast(seq as bigint) as seq, text, cx_px, cy_px, bottom_px, h_px, w_px, left_pt, right_pt from ({OCR})")
def ocr_geometry(p: Pages) -> DataFrame:
    return J.ocr_geometry(p.ocr_tokens)


@query("""with l as (select a.page_id, a.block_id, a.x0, a.y0, a.x1, a.y1, page_h, min(b.y0 + 5) as nxt from blocks a join page_dims d on d.page_id = a.page_id left join blocks b
 on b.page_id = a.page_id and b.block_id <> a.block_id and b.y0 > a.y1 and greatest(0.0, least(a.x1,b.x1)-greatest(a.x0,b.x0)) > (a.x1-a.x0)*0.1 group by all)
select page_id, cast(block_id as bigint) as block_id, x0-60 as wx0, y0-20 as wy0, x1+60 as wx1, greatest(y1+10, case when nxt is null then least(y1+150, page_h) else least(y1+150, page_h, nxt) end) as wy1 from l""")
def search_windows(p: Pages) -> DataFrame:
    return J.search_windows(p.blocks, p.page_dims)


@query(f"select page_id, cast(window_id as bigint) as window_id, cast(seq as bigint) as seq, text, row_number() over (partition by page_id order by window_id, seq) - 1 as title_id from ({OCR})")
def title_ids(p: Pages) -> DataFrame:
    return J.title_ids(J.ocr_geometry(p.ocr_tokens)).select("page_id", "window_id", "seq", "text", "title_id")


@query(f"select page_id, cast(title_id as bigint) as title_id, {normal_sql('text')} as text from ({VALID})")
def valid_titles(p: Pages) -> DataFrame:
    return valid(p).select("page_id", "title_id", "text")


@query(f"with v as ({VALID}) select b.page_id, cast(b.block_id as bigint) as block_id, cast(v.title_id as bigint) as title_id from blocks b join v on v.page_id = b.page_id and cx_px/4 between x0-10 and x1+10 and cy_px/4 between y0 and y1")
def internal_titles(p: Pages) -> DataFrame:
    return J.internal(p.blocks, valid(p)).select("page_id", "block_id", "title_id")


BELOW = "right_pt >= b.x0-60 and left_pt <= b.x1+60 and cy_px/4 >= b.y1-30 and cy_px/4 <= b.y1+150"
OWN = f"v as ({VALID}), own as (select distinct b.page_id, b.block_id from blocks b join v on v.page_id = b.page_id and cx_px/4 between x0-10 and x1+10 and cy_px/4 between y0 and y1)"


@query(f"""with {OWN}, g as (select b.page_id, b.block_id, max(bottom_px/4)+1 as low, min(left_pt)-10 as lo, max(right_pt)+10 as hi from blocks b anti join own on own.page_id = b.page_id and own.block_id = b.block_id
 join v on v.page_id = b.page_id and {BELOW} group by all)
select b.page_id, cast(b.block_id as bigint) as block_id, case when low > y1 then least(x0, lo) else x0 end as x0, y0, case when low > y1 then greatest(x1, hi) else x1 end as x1, case when low > y1 then low else y1 end as y1, coalesce(low > y1, false) as grew
from blocks b left join g on g.page_id = b.page_id and g.block_id = b.block_id""")
def title_reclaim(p: Pages) -> DataFrame:
    return J.title_reclaim(p.blocks, valid(p))


@query(f"""with {OWN}, g as (select b.page_id, b.block_id, max(bottom_px/4)+1 as low, min(left_pt)-10 as lo, max(right_pt)+10 as hi from blocks b anti join own on own.page_id = b.page_id and own.block_id = b.block_id
 join v on v.page_id = b.page_id and {BELOW} group by all)
select b.page_id, cast(b.block_id as bigint) as block_id, least(x0, coalesce(lo, x0)) as x0, y0, greatest(x1, coalesce(hi, x1)) as x1, greatest(y1, coalesce(low, y1)) as y1, coalesce(low > y1, false) as grew
from blocks b anti join own on own.page_id = b.page_id and own.block_id = b.block_id left join g on g.page_id = b.page_id and g.block_id = b.block_id""")
def second_reclaim(p: Pages) -> DataFrame:
    """Blocks that hold no title look below once more, and widen whether they grow or not."""
    titled = J.internal(p.blocks, valid(p)).select("page_id", "block_id").distinct()
    return J.reclaimed(p.blocks.join(titled, ["page_id", "block_id"], "left_anti"), valid(p), widen_always=True)


LOW = VALID.replace("cy_px, bottom_px", "cy_px + 2000 as cy_px, bottom_px + 2000 as bottom_px")


@query(f"""with v as ({LOW}), own as (select distinct b.page_id, b.block_id, title_id from blocks b join v on v.page_id = b.page_id and cx_px/4 between x0-10 and x1+10 and cy_px/4 between y0 and y1),
c as (select page_id, title_id from own union select v.page_id, v.title_id from blocks b anti join own on own.page_id = b.page_id and own.block_id = b.block_id join v on v.page_id = b.page_id and {BELOW})
select v.page_id, cast(v.title_id as bigint) as title_id, greatest(0.0, left_pt-15) as x0, greatest(0.0, cy_px/4-45) as y0, least(page_w, right_pt+15) as x1, least(page_h, cy_px/4+10) as y1
from v anti join c on c.page_id = v.page_id and c.title_id = v.title_id join page_dims d on d.page_id = v.page_id""")
def ghost_blocks(p: Pages) -> DataFrame:
    """Every title of the sample has a block near it, so all are moved down by 500 pt."""
    low = valid(p).withColumn("cy_px", F.col("cy_px") + 2000).withColumn("bottom_px", F.col("bottom_px") + 2000)
    return J.ghosts(p.blocks, low, p.page_dims)


@query(f"with v as ({VALID}) select b.page_id, cast(b.block_id as bigint) as block_id, cast(v.title_id as bigint) as title_id from blocks b join v on v.page_id = b.page_id and cx_px/4 between x0-20 and x1+20 and cy_px/4 between y0-20 and y1+20")
def halo_join(p: Pages) -> DataFrame:
    return J.halo(p.blocks, valid(p)).select("page_id", "block_id", "title_id")


@query(f"with v as ({VALID}) select b.page_id, cast(b.block_id as bigint) as block_id, count(*) as n, max(bottom_px/4)+1 as low from blocks b join v on v.page_id = b.page_id and cx_px/4 between x0-20 and x1+20 and cy_px/4 between y0-5 and y1+20 group by all")
def reassign_titles(p: Pages) -> DataFrame:
    return J.reassigned(p.blocks, valid(p)).groupBy("page_id", "block_id").agg(F.count("*").alias("n"), (F.max(F.col("bottom_px") / 4) + 1).alias("low"))


ARGMIN = f"""select page_id, title_id, block_id from (select v.page_id, v.title_id, b.block_id, row_number() over (partition by v.page_id, v.title_id order by (x1-x0)*(y1-y0), b.block_id) as r
 from ({VALID}) v join blocks b on b.page_id = v.page_id and cx_px/4 between x0-10 and x1+10 and cy_px/4 between y0-5 and y1+10) where r = 1"""


ORACLES["block_dedup"] = f"""with recursive a as ({ARGMIN}), n as (select page_id, block_id, list(title_id order by title_id) as titles from a group by all),
o as (select b.page_id, x0, y0, x1, y1, coalesce(titles, []) as titles, row_number() over (partition by b.page_id order by b.block_id) as r from blocks b left join n on n.page_id = b.page_id and n.block_id = b.block_id),
t as (select page_id, r, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'titles': titles}}] as kept from o where r = 1
 union all select page_id, r, case when spot is null or spot = 0 then list_append(kept, {{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'titles': titles}})
  else list_transform(kept, lambda k, i: case when i = spot then {{'x0': least(k.x0, x0), 'y0': least(k.y0, y0), 'x1': greatest(k.x1, x1), 'y1': greatest(k.y1, y1), 'titles': list_concat(k.titles, list_filter(titles, lambda e: not list_contains(k.titles, e)))}} else k end) end
 from (select o.*, kept, list_position(list_transform(kept, lambda k: greatest(0, least(k.x1, o.x1) - greatest(k.x0, o.x0)) * greatest(0, least(k.y1, o.y1) - greatest(k.y0, o.y0)) / (least((k.x1-k.x0)*(k.y1-k.y0), (o.x1-o.x0)*(o.y1-o.y0)) + 1e-6) > 0.6), true) as spot
  from t join o on o.page_id = t.page_id and o.r = t.r + 1)),
kept as (select page_id, unnest(kept) as k, unnest(range(len(kept))) as idx from (select page_id, arg_max(kept, r) as kept from t group by page_id))
select page_id, idx, k.x0 as x0, k.y0 as y0, k.x1 as x1, k.y1 as y1, array_to_string(k.titles, '|') as titles from kept"""


@query(f"select page_id, cast(title_id as bigint) as title_id, cast(block_id as bigint) as block_id from ({ARGMIN})")
def argmin_assign(p: Pages) -> DataFrame:
    return J.argmin_assign(p.blocks, valid(p))


@query(f"with a as ({ARGMIN}) select b.page_id, cast(b.block_id as bigint) as block_id, row_number() over (partition by b.page_id order by b.block_id) - 1 as idx from blocks b semi join a on a.page_id = b.page_id and a.block_id = b.block_id")
def untitled_drop(p: Pages) -> DataFrame:
    return J.titled_only(p.blocks, J.argmin_assign(p.blocks, valid(p))).select("page_id", "block_id", "idx")


HALO = f"select b.page_id, b.block_id, x0, y0, x1, y1, v.title_id, cx_px, cy_px, bottom_px, left_pt, right_pt from blocks b join ({VALID}) v on v.page_id = b.page_id and cx_px/4 between x0-20 and x1+20 and cy_px/4 between y0-20 and y1+20"


@query(f"select page_id, cast(block_id as bigint) as block_id, cast(title_id as bigint) as title_id from ({HALO}) where y1 - y0 > 2 and cx_px/4 between x0-10 and x1+10 and cy_px/4 between y0-10 and y1+10")
def sanity_filter(p: Pages) -> DataFrame:
    return J.sanity(p.blocks, J.halo(p.blocks, valid(p)).select("page_id", "block_id", "title_id"), valid(p))


# Rows

ROWS = f"""select *, sum(jump) over (partition by page_id, block_id order by cy_px, title_id rows unbounded preceding) as row_no from
 (select *, case when cy_px - lag(cy_px) over (partition by page_id, block_id order by cy_px, title_id) > 60 then 1 else 0 end as jump from ({HALO}))"""


def halos(p: Pages) -> DataFrame:
    return J.halo(p.blocks, valid(p))


@query(f"select page_id, cast(block_id as bigint) as block_id, cast(title_id as bigint) as title_id, cast(row_no as bigint) as row from ({ROWS})")
def y_groups(p: Pages) -> DataFrame:
    return R.y_groups(halos(p)).select("page_id", "block_id", "title_id", "row")


EXTENT = f"select page_id, block_id, row_no, min(left_pt) as lo, max(right_pt) as hi, max(bottom_px)/4 as low from ({ROWS}) group by page_id, block_id, row_no"
OVER = f"""select a.page_id, a.block_id, count(*) as n_rows, bool_or(coalesce(a.lo < b.hi and b.lo < a.hi, false)) as stacked from ({EXTENT}) a left join ({EXTENT}) b on b.page_id = a.page_id and b.block_id = a.block_id and b.row_no = a.row_no + 1 group by a.page_id, a.block_id"""


@query(f"select page_id, cast(block_id as bigint) as block_id, n_rows, stacked from ({OVER})")
def group_overlap(p: Pages) -> DataFrame:
    return R.group_overlap(halos(p))


@query(f"""with recursive e as (select page_id, block_id, cast(row_no as bigint) as row_no, low from ({EXTENT})), o as ({OVER}),
c as (select b.page_id, b.block_id, b.x0, b.x1, b.y1, e.row_no, b.y0 as a, greatest(least(b.y1, e.low+1), b.y0+1) as z, greatest(e.low+5, greatest(least(b.y1, e.low+1), b.y0+1)) as nxt
  from blocks b join o on o.page_id = b.page_id and o.block_id = b.block_id and o.stacked join e on e.page_id = b.page_id and e.block_id = b.block_id and e.row_no = 0
 union all select c.page_id, c.block_id, c.x0, c.x1, c.y1, e.row_no, c.nxt, greatest(least(c.y1, e.low+1), c.nxt+1), greatest(e.low+5, greatest(least(c.y1, e.low+1), c.nxt+1))
  from c join e on e.page_id = c.page_id and e.block_id = c.block_id and e.row_no = c.row_no + 1)
select page_id, cast(block_id as bigint) as block_id, row_no as part, x0, a as y0, x1, z as y1, true as stacked from c
union all select b.page_id, cast(b.block_id as bigint), 0, x0, y0, x1, y1, false from blocks b join o on o.page_id = b.page_id and o.block_id = b.block_id and not o.stacked""")
def vertical_split(p: Pages) -> DataFrame:
    return R.vertical_split(p.blocks, halos(p))


@query(f"""with l as (select page_id, block_id, max(bottom_px)/4 + 1 as low from ({HALO}) group by page_id, block_id), o as ({OVER})
select b.page_id, cast(b.block_id as bigint) as block_id, x0, y0, x1, greatest(least(y1, low), y0+1) as y1 from blocks b join l on l.page_id = b.page_id and l.block_id = b.block_id join o on o.page_id = b.page_id and o.block_id = b.block_id and not (n_rows >= 2 and stacked)""")
def bottom_clip(p: Pages) -> DataFrame:
    return R.bottom_clip(p.blocks, halos(p))


# Runs

ROI = """select b.page_id, block_id, greatest(0.0, x0) as x0, greatest(0.0, y0) as y0, least(page_w, x1) as x1, least(page_h, y1) as y1, greatest(0, trunc(greatest(0.0,x0)*4)::int) as px0, greatest(0, trunc(greatest(0.0,y0)*4)::int) as py0,
 least(trunc(page_w*4)::int, trunc(least(page_w,x1)*4)::int) as px1, least(trunc(page_h*4)::int, trunc(least(page_h,y1)*4)::int) as py1 from blocks b join page_dims d on d.page_id = b.page_id"""


@query(f"""with r as ({ROI}), e as (select r.page_id, r.block_id, min(greatest(x_start, px0)) as lft, max(least(x_end, px1)) - 1 as rgt, min(y) as top, max(y) as low from r join ink_runs i
 on i.page_id = r.page_id and y >= py0 and y < py1 and x_start < px1 and x_end > px0 group by all)
select r.page_id, cast(r.block_id as bigint) as block_id, case when lft is null then x0 else greatest(px0, lft-60)/4.0::double end as x0, case when lft is null then y0 else greatest(py0, top-20)/4.0::double end as y0,
 case when lft is null then x1 else least(px1-1, rgt+60)/4.0::double end as x1, case when lft is null then y1 else least(py1-1, low+20)/4.0::double end as y1 from r left join e on e.page_id = r.page_id and e.block_id = r.block_id""")
def content_trim(p: Pages) -> DataFrame:
    return I.content_trim(p.blocks, p.page_dims, p.ink_runs, 60, 20, bottom=True)


def joined_runs(runs: str, gap: int = 0) -> str:
    """Runs of a scanline at most `gap` apart as one, in SQL."""
    return f"""select page_id, y, min(x_start) as x_start, max(x_end) as x_end from (select *, sum(fresh) over (partition by page_id, y order by x_start, x_end rows unbounded preceding) as island from
 (select *, coalesce(x_start - max(x_end) over (partition by page_id, y order by x_start, x_end rows between unbounded preceding and 1 preceding) > {gap}, false)::int as fresh from {runs})) group by page_id, y, island"""


PIXELS = """select b.page_id, block_id, x0, y0, x1, y1, greatest(0, trunc(x0*4)::int) as px0, greatest(0, trunc(y0*4)::int) as py0,
 least(trunc(page_w*4)::int, trunc(x1*4)::int) as px1, least(trunc(page_h*4)::int, trunc(y1*4)::int) as py1 from {0} b join page_dims d on d.page_id = b.page_id"""
OWN_BLOCK = "partition by page_id, block_id"


@query(f"""with r as ({PIXELS.format("blocks")}), big as (select * from r where px1 - px0 >= 100 and py1 - py0 >= 20),
i as (select distinct b.page_id, b.block_id, greatest(x_start, px0) - px0 as a, least(x_end, px1) - px0 as e, px1 - px0 as width from big b join ink_runs k on k.page_id = b.page_id and y >= py0 and y < py1 and x_start < px1 and x_end > px0),
n as (select *, (a - coalesce(max(e) over ({OWN_BLOCK} order by a, e rows between unbounded preceding and 1 preceding), 0) >= 3)::int as new from i),
g as (select *, sum(new) over ({OWN_BLOCK} order by a, e rows unbounded preceding) as island from n),
s as (select page_id, block_id, case when island = 0 then 0 else min(a) end as a, max(e) as e, max(width) as width from g group by page_id, block_id, island),
q as (select *, e = max(e) over ({OWN_BLOCK}) and width - max(e) over ({OWN_BLOCK}) < 3 as to_end, count(*) over ({OWN_BLOCK}) as parts from s),
v as (select q.page_id, q.block_id, x0 + a/4.0::double as nx0, y0, case when to_end then x1 else x0 + e/4.0::double end as nx1, y1, not (parts = 1 and a = 0 and to_end) as was_split from q join big b on b.page_id = q.page_id and b.block_id = q.block_id)
select page_id, cast(block_id as bigint) as block_id, row_number() over ({OWN_BLOCK} order by nx0) - 1 as part, nx0 as x0, y0, nx1 as x1, y1, was_split from v where nx1 - nx0 > 30 or not was_split
union all select page_id, block_id, 0, x0, y0, x1, y1, false from r where px1 - px0 < 100 or py1 - py0 < 20""")
def x_split(p: Pages) -> DataFrame:
    return I.x_split(p.blocks, p.page_dims, p.ink_runs)


@query(f"""with r as ({joined_runs("ink_runs")}),
t as (select distinct v.page_id, greatest(0, trunc(left_pt*4)::int - 8) as bx0, greatest(0, trunc(bottom_px - h_px)::int - 8) as by0, least(trunc(page_w*4)::int, trunc(right_pt*4)::int + 8) as bx1, least(trunc(page_h*4)::int, trunc(bottom_px)::int + 8) as by1
 from ({VALID}) v join page_dims d on d.page_id = v.page_id),
h as (select r.*, bx0, bx1 from r join t on t.page_id = r.page_id and y >= by0 and y < by1 and bx0 < x_end and bx1 > x_start and bx0 < bx1),
s as (select page_id, y, x_start, x_end, x_start as spot from r union select page_id, y, x_start, x_end, bx1 from h where bx1 < x_end),
k as (select s.* from s anti join h on h.page_id = s.page_id and h.y = s.y and h.x_start = s.x_start and bx0 <= spot and spot < bx1)
select k.page_id, cast(k.y as bigint) as y, cast(spot as bigint) as x_start, cast(least(k.x_end, coalesce(min(bx0), k.x_end)) as bigint) as x_end
from k left join h on h.page_id = k.page_id and h.y = k.y and h.x_start = k.x_start and bx0 > spot group by k.page_id, k.y, k.x_start, k.x_end, spot""")
def title_mask(p: Pages) -> DataFrame:
    return I.title_mask(p.ink_runs, valid(p), p.page_dims)


GROWN = """(select distinct page_id, y + cast(dy as int) as y, greatest(x_start-14, 0) as x_start, least(x_end+14, 4800) as x_end from ink_runs cross join (select unnest(range(-14, 15)) as dy) where y + dy >= 0 and y + dy < 3200)"""


@query(f"""with b as (select page_id, block_id, x0, y0 + 2.5::double as y0, x1, y1 from blocks), r as ({PIXELS.format("b")}),
w as (select distinct r.page_id, block_id, py0, y from r join {GROWN} k on k.page_id = r.page_id and px1 > px0 and y <= py0 and y > py0 - 200 and x_start < px1 and x_end > px0),
g as (select *, py0 - y - row_number() over ({OWN_BLOCK} order by y desc) + 1 as gap from w),
u as (select page_id, block_id, greatest(min(y) - 1, 0) as high from g where gap = 0 group by page_id, block_id)
select b.page_id, cast(b.block_id as bigint) as block_id, x0, case when high is not null and y0*4 >= 1 then high/4.0::double else y0 end as y0, x1, y1 from b left join u on u.page_id = b.page_id and u.block_id = b.block_id""")
def top_recovery(p: Pages) -> DataFrame:
    down = p.blocks.withColumn("y0", F.col("y0") + 2.5)
    return I.top_recovery(down, p.page_dims, I.grown(p.ink_runs, p.page_dims))


@query("""with i as (select *, coalesce(x_start > max(x_end) over w, false)::int as fresh from ink_runs window w as (partition by page_id, y order by x_start, x_end rows between unbounded preceding and 1 preceding)),
g as (select *, sum(fresh) over (partition by page_id, y order by x_start, x_end rows unbounded preceding) as island from i)
select page_id, cast(y as bigint) as y, cast(min(x_start) as bigint) as x_start, cast(max(x_end) as bigint) as x_end from g group by page_id, y, island""")
def merged_runs(p: Pages) -> DataFrame:
    return I.merged(p.ink_runs)


@query("""with px as (select distinct page_id, y + cast(dy as int) as y, greatest(x_start-14, 0) as x_start, least(x_end+14, 4800) as x_end from ink_runs cross join (select unnest(range(-14, 15)) as dy) where y + dy >= 0 and y + dy < 3200),
i as (select *, coalesce(x_start > max(x_end) over w, false)::int as fresh from px window w as (partition by page_id, y order by x_start, x_end rows between unbounded preceding and 1 preceding)),
g as (select *, sum(fresh) over (partition by page_id, y order by x_start, x_end rows unbounded preceding) as island from i)
select page_id, cast(y as bigint) as y, cast(min(x_start) as bigint) as x_start, cast(max(x_end) as bigint) as x_end from g group by page_id, y, island""")
def dilate(p: Pages) -> DataFrame:
    return I.dilate(p.ink_runs, p.page_dims)


@query(f"""select page_id, cast(y as bigint) as y, cast(x_start as bigint) as x_start, cast(x_end as bigint) as x_end
from ({joined_runs("ink_runs", 100)}) join page_dims using (page_id) where x_end - x_start >= floor(page_w*4*5/100)""")
def long_lines(p: Pages) -> DataFrame:
    """At 5 percent of the page's width, as no run of the sample is longer."""
    return I.long_lines(p.ink_runs, p.page_dims, Config(line_percent=5))


COLUMNS = joined_runs("(select distinct page_id, cast(unnest(range(x_start, x_end)) as int) as y, y as x_start, y + 1 as x_end from ink_runs)", 100)


@query(f"select page_id, cast(y as bigint) as x, cast(x_start as bigint) as y_start, cast(x_end as bigint) as y_end from ({COLUMNS}) join page_dims using (page_id) where x_end - x_start >= floor(page_h*4*10/100)")
def long_columns(p: Pages) -> DataFrame:
    """At 10 percent of the page's height, as no column of the sample is longer."""
    return I.long_columns(p.ink_runs, p.page_dims, Config(line_percent=10))


@query()
def components(p: Pages) -> DataFrame:
    return I.components(I.grown(p.ink_runs, p.page_dims))


@query()
def pipeline_blocks(p: Pages) -> DataFrame:
    """The whole pipeline on the sample pages: final blocks with their titles.

    Groups of whole pages go through it one after the other, so the disk holds the versions of one group at a time.
    """
    done = [full_pipeline(q.components, q.titles, q.ink_runs, q.page_dims) for q in p.parts(PART_ROWS)]
    return reduce(DataFrame.union, done).select("page_id", "block_id", "x0", "y0", "x1", "y1", joined("titles").alias("titles"))
