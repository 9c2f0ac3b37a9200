"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from riskloom.llm import license

_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>')"

OP1 = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -7, i, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(i, r)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(4 + length(replace({_ESCAPED.format('role')}, ':', '\:')) + 2 + length({_ESCAPED.format('text')}) + 8)::bigint as formatted_chars
from c group by conv_id
"""

_WORDS = "len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::bigint"

OP3 = f"""
with d as (select doc_id, source, {_WORDS} as size, ('0x' || substr(md5(coalesce(doc_id::varchar, text, 'null')), 1, 8))::bigint as r from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as w from s),
f as (
  select *, (select sum(source_size) from s) - coalesce(sum(3 * source_size) over (o rows between unbounded preceding and 1 preceding), 0) as lft,
    sum(w) over (o rows between current row and unbounded following) as wsum
  from w window o as (order by source_size * 3 / w, source nulls last)
),
g as (select *, lft * w > source_size * 3 * wsum as capped from f),
p as (select lft, wsum from g where not capped order by wsum desc, lft desc limit 1),
t as (
  select source, source_size,
    case when capped then (source_size * 3)::double else (p.lft * w)::double / p.wsum end as target
  from g, p
),
n as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as sure from t),
e as (select d.*, source_size, target, sure, greatest(0.0, target - sure * source_size) as need, case when size > 0 then (1::bigint << (length(bin(size)) - 1)) else 0 end as v
  from d join n on d.source is not distinct from n.source),
k as (select source, v, any_value(need) as need, sum(size) as n from e where v > 0 group by source, v),
l as (select source, v, need - coalesce(sum(n) over (o rows between unbounded preceding and 1 preceding), 0)::double as lft,
    (sum(n::hugeint * v) over (o rows between current row and unbounded following))::double as rest
  from k window o as (partition by source order by v desc)),
c as (select source, max_by(lft / rest, case when lft * v <= rest then v end) as c from l group by source),
q as (select e.*, coalesce(c, 0) * v as p, (r + 0.5::double) / 4294967296.0::double as u from e left join c on e.source is not distinct from c.source),
z as (select *, case when size = 0 then null when p >= 1 then 0 when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as z from q),
y as (select source, z, r, doc_id, size, any_value(need) as need, sum(size) as n from z where z is not null group by source, z, r, doc_id, size),
h as (select *, coalesce(sum(n) over (partition by source order by z, r, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as held from y),
b as (select *, min(case when held + n > need then held end) over (partition by source) as stop from h),
i as (select *, need - stop as gap from b where held > stop and size <= need - stop),
j as (select *, coalesce(sum(n) over (partition by source order by held rows between unbounded preceding and 1 preceding), 0) as held2 from i),
m as (select source, z, r, doc_id, size from b where need > 0 and (stop is null or held < stop) union all select source, z, r, doc_id, size from j where 2 * (gap - held2) >= n)
select z.doc_id, z.size, source_size, target, ((sure + (m.z is not null)::int) * z.size)::bigint as taken
from z left join m on z.source is not distinct from m.source and z.z = m.z and z.r = m.r and z.doc_id is not distinct from m.doc_id and z.size = m.size
"""



def _normal(text: str) -> str:
    """riskloom.llm.license.normalise in SQL."""
    out = f"trim(regexp_replace(regexp_replace(lower(coalesce({text}, '')), '(?m){license.COPYRIGHT}', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for old, new in license.SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def _values(rows) -> str:
    return ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in r)) for r in rows)


OP6 = f"""
with k as (select distinct on (digest) digest, license from (
  select sha256({_normal('t')}) as digest, l as license from (values {_values(license.TEXTS)}) v(l, t)
  union all select d, l from (values {_values(license.DIGESTS)}) v(l, d))),
n as (select sha256({_normal('t')}) as digest, l as name from (values {_values(license.NOTICES)}) v(l, t)),
x as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),
f as (select doc_id, string_agg(distinct name, ',' order by name) as notices from x join n on sha256({_normal('line')}) = n.digest where lower(line) like '%licen%' group by 1),
d as (select doc_id, sha256({_normal('text')}) as norm_sha256 from documents)
select d.doc_id, norm_sha256, coalesce(notices, '') as notices, license from d left join f using (doc_id) left join k on norm_sha256 = digest
"""

#: Terms are found in bytes that aren't ASCII letters or digits, A-Z lowered.
_TERMS = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP11 = f"""
with d as (select doc_id, {_TERMS.format('text')} as ts from documents),
s as (select count(*)::bigint as n_docs, sum(len(ts))::bigint as total from d where len(ts) > 0),
i as (select row_number() over () as k, item_id, {_TERMS.format('text')} as ts from benchmark),
q as (select k, item_id, t, count(*)::bigint as times from (select k, item_id, unnest(ts) as t from i) group by all),
p as (select r, doc_id, n, t, count(*)::bigint as tf from (select r, doc_id, n, unnest(ts) as t from (select row_number() over () as r, doc_id, len(ts)::bigint as n, ts from d)) where t in (select t from q) group by all),
w as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as w from (select t, count(*)::bigint as df from p group by t), s),
v as (select r, doc_id, p.t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // total)))) as v from p join w on p.t = w.t, s),
x as (select k, item_id, r, doc_id, sum(times * v)::bigint as score from q join v on q.t = v.t group by all)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by k order by score desc, doc_id nulls last, r) as rank from x where score > 0) where rank <= 20
"""

ORACLE: dict[str, str] = {"op1_chat_formatting": OP1, "op3_mixing": OP3, "op6_license_scan": OP6, "op11_ranked_search": OP11}
