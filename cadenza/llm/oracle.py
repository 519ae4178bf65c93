"""DuckDB SQL for the queries that SQL can express."""

from .url_filter import SUFFIXES

OP6 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, i, case when i = 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) r(i)
),
c as (
  select *,
    contains(role, '[INST]') or contains(role, '[/INST]') or contains(role, '</s>') or contains(role, '\0') or contains(role, '\1') or contains(role, '\2')
    or contains(text, '[INST]') or contains(text, '[/INST]') or contains(text, '</s>') or contains(text, '\0') or contains(text, '\1') or contains(text, '\2') as clash
  from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn nulls first, role, text)) as loss_sha256,
  cast(sum(length('[INST]' || role || '[/INST]' || text || '</s>') + case when clash then length(regexp_replace(role || text, '[^\\\[<]', '', 'g')) else 0 end) as bigint) as formatted_chars
from c group by conv_id
"""

OP8 = r"""
with u as (
  select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
),
p as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
),
worst as (select doc_id as page_id, max(case when quality is null and toxic is null then null when quality = 0 or toxic = 1 then 1 when quality is null or toxic is null then null else 0 end) as bad from labels group by doc_id),
h0 as (select regexp_replace(host, ':[0-9]*$', '') as host, count(bad) as n, coalesce(sum(bad), 0)::bigint as x from p left join worst using (page_id) group by 1),
h1 as (select *, string_split(host, '.') as labels, array_to_string(string_split(host, '.')[-2:], '.') as two, regexp_matches(host, '^[0-9]+([.][0-9]+){3}$|^\[.*\]$') as address from h0),
h2 as (select *, two in (@SUFFIXES) as paired from h1),
h as (
  select host, n, x, case when address then host when paired then array_to_string(labels[-3:], '.') else two end as domain,
    case when address then '(address)' when paired then two else labels[-1] end as suffix
  from h2
),
d as (select domain, suffix, sum(n)::bigint as n, sum(x)::bigint as x from h group by all),
s as (select suffix, sum(n)::bigint as n, sum(x)::bigint as x from d group by all),
levels as (select 'h' as level, n, x from h union all select 'd', n, x from d union all select 's', n, x from s),
sums as (
  select level, count(*)::double as k, sum(n)::double as nn, sum(x)::double as xx, sum(n::double * n) as n2, sum(x::double * x / n) as x2
  from levels where n > 0 group by level
),
moments as (select *, xx / nn as p, (xx / nn) * (1 - xx / nn) as v from sums),
rho as (select level, ((x2 - nn * p * p) / nullif(k - 1, 0) - v) / nullif(((nn - n2 / nn) / nullif(k - 1, 0) - 1) * v, 0) as rho from moments),
strength as (select level, case when rho > 0 then greatest(2.0::double, least(10000.0::double, 1 / rho - 1)) else 10000.0::double end as s from rho),
ss as (
  select coalesce((select s from strength where level = 's'), 10000.0::double) as s1, coalesce((select s from strength where level = 'd'), 10000.0::double) as s2,
    coalesce((select s from strength where level = 'h'), 10000.0::double) as s3, (select coalesce(sum(x)::double / nullif(sum(n), 0), 0) from s) as m0
),
m1 as (select suffix, (x + s1 * m0) / (n + s1) as m1 from s, ss),
m2 as (select domain, (x + s2 * m1) / (n + s2) as m2 from d join m1 using (suffix), ss),
r as (select host, n, (x + s3 * m2) / (n + s3) as m, s3 from h join m2 using (domain), ss),
q as (select host, m as bad_mean, greatest(0.0::double, m - 1.645::double * sqrt(m * (1 - m) / (n + s3 + 1))) as bad_bound from r),
rules(verdict, name, prefix) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
urls as (select distinct host, path from p),
hits as (
  select host, path, arg_max(struct_pack(verdict := verdict, rule := name || prefix), length(name || prefix)) as hit
  from urls join rules on (host = name or ends_with(host, '.' || name)) and starts_with(path, prefix) group by host, path
)
select page_id, p.host, p.path, hit.rule as rule, coalesce(hit.verdict, case when bad_bound > 0.3::double then 'block' else 'allow' end) as verdict,
  round(bad_mean, 6) as bad_mean, round(bad_bound, 6) as bad_bound
from p join q on regexp_replace(p.host, ':[0-9]*$', '') = q.host left join hits on p.host = hits.host and p.path = hits.path
"""

OP8 = OP8.replace("@SUFFIXES", ", ".join(f"'{x}'" for x in SUFFIXES))

OP5 = r"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, sha256(html) as payload_digest, strlen(html) as payload_bytes from p),
f as (select payload_digest, min(page_id) as first, count(*) as copies from d where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, d.payload_digest, case when copies > 1 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when copies > 1 and page_id <> first then first end as refers_to
from d left join f on d.payload_digest = f.payload_digest
"""


#: CRC32 by the rule of its polynomial: a table of 256 steps, then a step a byte.
STEPS = "steps(t) as (select list(c order by i) from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i)))"


def _crc32(text: str) -> str:
    """Of a text's UTF-8; needs ``steps`` in the query."""
    listed = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda p: ('0x' || p)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {listed}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _kd_tree(shards: int) -> str:
    """Level by level: extents of each node, its widest dimension, rows in order along it, those whose middle byte lies up to the target go left."""
    h = lambda x: f"cast('0x' || substr(md5({x}), 1, 15) as bigint)"
    kept = "doc_id, size, text_crc32, by_text, by_row, d0, d1, d2, d3"
    sql = f"""
with {STEPS},
r0 as (
  select doc_id, coalesce(strlen(text), 0) + 16 as size, coalesce(text, '') as text, coalesce({h("text")}, 0) as by_text, doc_id as m0, {h("source")} as m1, {h("lang")} as m2, n_chars as m3,
    {h("coalesce(doc_id::varchar, '-') || ',' || coalesce(source, '-') || ',' || coalesce(lang, '-') || ',' || coalesce(n_chars::varchar, '-') || ','")} as by_row from documents
),
least as (select {", ".join(f"coalesce(min(m{i}), 0) as o{i}, (coalesce(max(m{i}), 0) - coalesce(min(m{i}), 0))::double as g{i}" for i in range(4))} from r0),
n0 as (select doc_id, size, {_crc32("text")} as text_crc32, by_text, by_row, {", ".join(f"coalesce(m{i}, o{i}) as d{i}" for i in range(4))}, 0 as first, {shards} as leaves from r0, least, steps)"""
    level = 0
    while 2**level < shards:
        width = [f"case when any_value(g{i}) > 0 then (max(d{i}) - min(d{i}))::double / any_value(g{i}) else 0::double end as w{i}" for i in range(4)]
        sql += f""",
e{level} as (select first, {", ".join(width)}, sum(size) as weight from n{level}, least group by first),
k{level} as (
  select n.*, weight, case when w0 >= greatest(w1, w2, w3) then d0 when w1 >= greatest(w2, w3) then d1 when w2 >= w3 then d2 else d3 end as k from n{level} n join e{level} using (first)
),
c{level} as (select *, 2 * sum(size) over (partition by first order by k, by_text, by_row rows unbounded preceding) - size as middle from k{level}),
n{level + 1} as (
  select {kept}, case when leaves = 1 or middle <= 2 * weight * (leaves // 2) // leaves then first else first + leaves // 2 end as first,
    case when leaves = 1 then 1 when middle <= 2 * weight * (leaves // 2) // leaves then leaves // 2 else leaves - leaves // 2 end as leaves from c{level}
)"""
        level += 1
    return sql + f"""
select doc_id, size, text_crc32, 'bytes' as law, first::int as shard, row_number() over (partition by first order by by_row, by_text) - 1 as slot, cast(null as int) as grown_shard from n{level}
"""


def _merkle(levels: int, upper: int) -> str:
    """Level by level: runs of three become their parents while a group has several nodes; leaves then climb with the siblings of their run, by ``levels`` and ``upper`` levels at most."""
    field = lambda x: f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"
    leaf = lambda t: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', t)))})"
    sql = f"""
with {STEPS},
docs as (
  select doc_id, text, case when source is null then '0' else '1' || source end as key, {leaf("text")} as leaf, {leaf("replace(text, chr(10), '')")} as other, {_crc32("doc_id::varchar")} % 2 = 0 as chosen
  from documents, steps
),
placed as (select *, case when chosen and text is not null then other else leaf end as forged, row_number() over (partition by key order by doc_id nulls first, leaf) - 1 as pos from docs),
a0 as (select key, pos, leaf as node, count(*) over (partition by key) as m from placed)"""

    def climb(name: str, k: int) -> str:
        return f""",
{name}r{k} as (
  select key, pos // 3 as run, any_value(m) as m, max(case when pos % 3 = 0 then node end) as n0, max(case when pos % 3 = 1 then node end) as n1, max(case when pos % 3 = 2 then node end) as n2
  from {name}{k} group by key, pos // 3
),
{name}{k + 1} as (
  select key, run as pos, case when m > 1 then sha256(n0 || coalesce(n1, '') || coalesce(n2, '')) else n0 end as node, case when m > 1 then (m + 2) // 3 else m end as m from {name}r{k}
)"""

    def fold(name: str, state: str, k: int) -> str:
        own = [f"coalesce(case when place % 3 = {i} then acc else n{i} end, '')" for i in range(3)]
        rest = [f"case when place % 3 = {i} then '' else coalesce(n{i}, '') end" for i in range(3)]
        return f""",
{state}{k + 1} as (
  select s.* exclude (acc, way, place), case when r.m > 1 then sha256({" || ".join(own)}) else acc end as acc, case when r.m > 1 then way || {" || ".join(rest)} else way end as way, place // 3 as place
  from {state}{k} s join {name}r{k} r on r.key = s.tree and r.run = s.place // 3
)"""

    for k in range(levels):
        sql += climb("a", k)
    sql += f""",
b0 as (select '' as key, row_number() over (order by key) - 1 as pos, node, count(*) over () as m, key as grp from a{levels})"""
    for k in range(upper):
        sql += climb("b", k)
    sql += """,
s0 as (select doc_id, key as tree, leaf, forged as acc, '' as way, pos as place from placed)"""
    for k in range(levels):
        sql += fold("a", "s", k)
    sql += f""",
u0 as (select s.* exclude (tree, place), '' as tree, b0.pos as place, b0.node as subroot from s{levels} s join b0 on b0.grp = s.tree)"""
    for k in range(upper):
        sql += fold("b", "u", k)
    return sql + f"""
select doc_id, leaf, subroot, b.node as root, sha256(way) as proof_sha256, acc as folded_root, acc = b.node as verified from u{upper}, b{upper} b
"""


ORACLE = {"op13_merkle": _merkle(13, 9), "op11_sharding": _kd_tree(40), "op5_warc": OP5, "op6_chat_format": OP6, "op8_url_filter": OP8}
