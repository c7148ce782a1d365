"""Page tables derived from the sample tables by SQL that any engine runs alike.

Coordinates are multiples of 0.25, hence exact. The whole of lineitem takes part.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: In order; each may use those before it and lineitem.
SQL = {
    "boxed": """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(floor(l_orderkey/8) as bigint) as page_id,
  cast(row_number() over (partition by cast(floor(l_orderkey/8) as bigint)
       order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 as int) as block_id,
  cast((l_partkey*37 + l_linenumber*211) % 4000 as int) as px0,
  cast((l_suppkey*53 + l_linenumber*97) % 2600 as int) as py0,
  cast(120 + (l_partkey % 7)*90 as int) as pw,
  cast(80 + (l_suppkey % 5)*60 as int) as ph
from lineitem""",
    "page_dims": "select distinct page_id, cast(1200 as double) as page_w, cast(800 as double) as page_h from boxed",
    "blocks": """
select page_id, block_id, px0/cast(4 as double) as x0, py0/cast(4 as double) as y0,
  (px0+pw)/cast(4 as double) as x1, (py0+ph)/cast(4 as double) as y1 from boxed""",
    "components": """
select page_id, block_id as comp_id, px0 as x, py0 as y,
  case when block_id % 17 = 0 then 3000 when block_id % 5 = 0 then 40 else pw end as w,
  case when block_id % 17 = 0 then 2000 when block_id % 5 = 0 then 50 else ph end as h,
  case when block_id % 4 = 0 then 'hole' else 'outer' end as kind from boxed""",
    "titles": """
select page_id, block_id as title_id,
  case cast(l_partkey % 6 as int)
    when 0 then concat('B', cast(l_linenumber as string), 'F B', cast(l_suppkey % 9 as string), '-', cast(l_partkey % 5 as string), ' (', cast(30 + (l_partkey % 5)*10 as string), 'x', cast(50 + (l_suppkey % 4)*10 as string), ')')
    when 1 then concat('RFCB', cast(l_suppkey % 9 as string), '（', cast(30 + (l_partkey % 5)*10 as string), '×60）')
    when 2 then concat(cast(l_linenumber as string), 'FG', cast(l_suppkey % 9 as string), '(40X60)')
    when 3 then concat(cast(4 + l_linenumber as string), '-#', cast(l_suppkey % 9 as string))
    when 4 then concat('S', cast(l_suppkey % 9 as string), '-01')
    else concat('  note  ', cast(l_suppkey as string), ' ') end as text,
  px0 + pw/cast(2 as double) as cx_px, cast(py0+ph+20 as double) as cy_px, cast(py0+ph+32 as double) as bottom_px,
  cast(24 as double) as h_px, cast(100 as double) as w_px,
  (px0 + pw/cast(2 as double) - 50)/cast(4 as double) as left_pt,
  (px0 + pw/cast(2 as double) + 50)/cast(4 as double) as right_pt
from boxed where l_partkey % 3 <> 1 or block_id % 2 = 0""",
    "text_blocks": """
select page_id, title_id as block_no, left_pt as x0, (bottom_px - h_px)/cast(4 as double) as y0,
  right_pt as x1, bottom_px/cast(4 as double) as y1, text, case when title_id % 11 = 0 then 1 else 0 end as block_type from titles""",
    "vectors": """
select page_id, block_id*2 + cast(k as int) as vec_seq, 'path' as type,
  (px0+8)/cast(4 as double) as x0, (py0+8)/cast(4 as double) as y0,
  (px0+pw-8)/cast(4 as double) as x1,
  case when k = 0 then (py0+ph-8)/cast(4 as double) else (py0+8)/cast(4 as double) end as y1
from boxed cross join (select 0 as k union all select 1 as k) q""",
    "ocr_tokens": """
select page_id, block_id as window_id, cast(k as int) as seq,
  cast(px0 + k*120 as double) as ax, cast(py0 + ph + 8 as double) as ay,
  cast(px0 + k*120 + 100 as double) as bx, cast(py0 + ph + 32 as double) as by_,
  case when k = 0 then concat('B', cast(l_linenumber as string), 'F') when k = 1 then concat('G', cast(l_suppkey % 9 as string))
       else case when l_partkey % 4 = 0 then '#note@' else '(40x60)' end end as text,
  l_linenumber/cast(8 as double) as conf
from boxed cross join (select 0 as k union all select 1 as k union all select 2 as k) q""",
    "ink_runs": """
select distinct page_id, y, x_start, x_end from (
  select page_id, py0 + 10 + cast(k as int)*16 as y, px0 + 8 as x_start, px0 + 8 + cast(floor(pw/3) as int) as x_end
  from boxed cross join (select 0 as k union all select 1 as k union all select 2 as k) q where block_id % 3 <> 2
  union all
  select page_id, py0 + 10 + cast(k as int)*16, px0 + 12 + cast(floor(pw/2) as int), px0 + pw - 4
  from boxed cross join (select 0 as k union all select 1 as k union all select 2 as k) q where block_id % 3 <> 2) z""",
    "rebar_items": """
select page_id as list_id, block_id as pos,
  case when l_partkey % 9 = 0 then '' when l_partkey % 7 = 0 then 'E.F' when l_partkey % 5 = 0 then concat(cast(l_linenumber as string), ' #', cast(l_suppkey % 9 as string))
       else concat(cast(l_linenumber + 9 as string), '-#', cast(l_suppkey % 9 as string)) end as item
from boxed""",
}


def needs(text: str) -> list[str]:
    """The derived tables that a query names, with those they need, in order."""
    found: set[str] = set()
    todo = [text]
    while todo:
        names = {n for n in re.findall(r"\b\w+\b", todo.pop()) if n in SQL}
        todo += [SQL[n] for n in names - found]
        found |= names
    return [n for n in SQL if n in found]


def with_fixtures(text: str) -> str:
    """One statement: the derived tables as common table expressions, then the query (which may begin with its own)."""
    ctes = ",\n".join(f"{n} as ({SQL[n].strip()})" for n in needs(text))
    body = text.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


class Pages:
    """The derived tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet")

    def parts(self, rows: int) -> list[Pages]:
        """The same tables for groups of whole pages, each of about `rows` rows of lineitem."""
        n = max(1, -(-self.lineitem.count() // rows))
        group = F.pmod(F.xxhash64(F.floor(F.col("l_orderkey") / 8)), F.lit(n))
        out = [Pages(self.spark, self.sf_dir) for _ in range(n)]
        for k, p in enumerate(out):
            p.__dict__["lineitem"] = self.lineitem.where(group == k)
        return out

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SQL:
            raise AttributeError(name)
        text = SQL[name]
        own = {n: getattr(self, n) for n in [*SQL, "lineitem"] if n != name and re.search(rf"(from|join) {n}\b", text)}
        for n in own:
            text = re.sub(rf"(from|join) {n}\b", rf"\1 {{{n}}}", text)
        df = self.spark.sql(text, **own)
        self.__dict__[name] = df
        return df
