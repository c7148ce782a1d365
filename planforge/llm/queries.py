"""The registered corpus queries and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planforge.llm.bpe import op9_bpe
from planforge.llm.decontaminate import op1_decontaminate
from planforge.llm.langid import op2_langid
from planforge.llm.media import op7_media
from planforge.llm.minhash import op5_minhash
from planforge.llm.sharding import op10_sharding
from planforge.llm.substrings import op3_substrings
from planforge.llm.suffixes import op6_suffixes
from planforge.llm.toxicity import op8_toxicity
from planforge.llm.urlfilter import op4_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_decontaminate, op2_langid, op3_substrings, op4_url_filter, op5_minhash, op6_suffixes, op7_media, op8_toxicity, op9_bpe, op10_sharding]
    return {f.__name__: f for f in own}


#: The 13-word windows as joined texts, as words hold no space.
OP3_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
k as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as s from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13)),
f as (select s, min(doc_id) as d from k group by s),
r as (select distinct k.doc_id, k.i + o.o as i from k join f using (s) cross join (select unnest(range(0, 13)) as o) o where f.d < k.doc_id),
x as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from w),
g as (select x.doc_id, string_agg(x.word, ' ' order by x.i) as kept, count(*) as n from x anti join r on r.doc_id = x.doc_id and r.i = x.i group by x.doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join g using (doc_id)
"""

#: Overlaps that tolerate substitutions always have four equal tokens in a row; these, not the masks, find the alignments here.
OP1_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as t from documents),
b as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as t from benchmark),
dg as (select doc_id, i, array_to_string(t[i:i + 3], ' ') as g from (select doc_id, t, unnest(range(1, len(t) - 2)) as i from d where len(t) >= 4)),
bg as (select item_id, j, array_to_string(t[j:j + 3], ' ') as g from (select item_id, t, unnest(range(1, len(t) - 2)) as j from b where len(t) >= 8)),
c as (select distinct doc_id, item_id, i - j as shift from dg join bg using (g)),
z as (select doc_id, item_id, shift, b.t as bt, d.t as dt, least(13, len(b.t)) as w, greatest(0, -shift) as f, least(len(b.t), len(d.t) - shift) as e from c join d using (doc_id) join b using (item_id)),
m as (select doc_id, item_id, shift, w, f, list_transform(range(f + 1, e + 1), lambda k: case when bt[k] = dt[k + shift] then 0 else 1 end) as x from z where e - f >= w),
g as (select *, list_filter(range(1, len(x) - w + 2), lambda s: list_sum(x[s:s + w - 1]) <= floor(2 * w / 13)) as good from m),
h as (select *, good[1] as a, good[len(good)] + w - 1 as o from g where len(good) > 0),
s as (select doc_id, item_id, d.t as dt, b.t as bt, unnest(range(0, len(d.t) - len(b.t) + 1)) as p from d join b on len(b.t) between 1 and 7 and len(d.t) >= len(b.t))
select doc_id, item_id, (shift + f + a - 1)::bigint as doc_start, (f + a - 1)::bigint as item_start, (o - a + 1)::bigint as length, (o - a + 1 - list_sum(x[a:o]))::bigint as same from h
union all select doc_id, item_id, p, 0, len(bt), len(bt) from s where dt[p + 1:p + len(bt)] = bt
"""

#: Sets of joined words; links between all sets that share a shingle; the smallest id over links.
OP5_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(case when len(ws) < 4 then ws else ws[i:i + 3] end, ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select md5(string_agg(g, chr(10) order by g)) as h, doc_id from s group by doc_id),
rep as (select h, min(doc_id) as r from c group by h),
m as (select c.doc_id, r from c join rep using (h)),
xr as (select s.g, s.doc_id from s join (select distinct r from m) q on s.doc_id = q.r),
p as (select a.doc_id as a, b.doc_id as b, count(*) as same from xr a join xr b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * same >= 80 * (na.n + nb.n - same)),
e as (select a, b from l union select b, a from l),
reach as (with recursive t(r, o) as (select r, r from rep union select t.r, e.b from t join e on e.a = t.o) select r, min(o) as o from t group by r)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(o, w.doc_id) as component_id, coalesce(o, w.doc_id) = w.doc_id as kept from w left join n using (doc_id) left join m using (doc_id) left join reach using (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op3_substrings": OP3_SQL, "op5_minhash": OP5_SQL}
