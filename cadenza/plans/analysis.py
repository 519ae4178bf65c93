"""The analytics view of tiers in their own labels, with and without the label source that a system really writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phones
from ..operators import metrics as M
from ..operators import score as E
from . import alignment as A
from . import fixtures as fx
from .fixture_sql import ALIGN, GOLD, HYP, with_
from .labelling import values


def forced_source(spark, sf_dir):
    """Words' first letters as phones; one system writes them in capitals with a stress mark but says otherwise. Errors over pairs of one class, by its own word and with the source forced."""
    first = F.substring("label", 1, 1)
    gold = fx.gold(spark, sf_dir).withColumns({"label": F.lower(first), "source": F.lit("timit61")})
    hyp = fx.hyp(spark, sf_dir).where("system = 'sys_a' and cond = 'clean'").withColumns({"label": F.concat(F.upper(first), F.lit("1")), "source": F.lit("timit61")})
    out = None
    for name, sources in (("own", None), ("forced", {"hyp": "arpabet"})):
        e = E.analysis_view(gold, hyp, sources).withColumn("source", F.lit(name))
        made = M.edge_split(e, ["source"]).join(e.groupBy("source").agg(F.countDistinct("utt_id").alias("n_utts"), F.count("*").alias("n")), "source")
        out = made if out is None else out.unionByName(made)
    return out


_KEYS = lambda source: values([(k, c) for k, c in phones.sources()[source][0].items()])
_MANNER = values([(s, m) for m, group in phones.MANNER.items() for s in group.split()])
SQL = with_(
    GOLD, HYP, f"tm(k, c) as {_KEYS('timit61')}", f"ar(k, c) as {_KEYS('arpabet')}", f"mn(l, c) as {_MANNER}",
    "g0 as (select g.*, lower(substr(label, 1, 1)) as key, tm.k is not null as hit, tm.c from gold g left join tm on tm.k = lower(substr(g.label, 1, 1)))",
    "gold_p as materialized (select utt_id, (row_number() over (partition by utt_id order by pos) - 1)::int as pos, case when hit then c else 'gold:UNMAPPED:' || pos end as label, start_us, end_us from g0 where not (hit and c is null))",
    """h0 as (
  select h.utt_id, 'own' as system, cond, pos, start_us, end_us, tm.k is not null as hit, tm.c from hyp h left join tm on tm.k = lower(upper(substr(h.label, 1, 1)) || '1') where system = 'sys_a' and cond = 'clean'
  union all
  select h.utt_id, 'forced', cond, pos, start_us, end_us, ar.k is not null, ar.c from hyp h left join ar on ar.k = regexp_replace(lower(upper(substr(h.label, 1, 1)) || '1'), '[0-2]$', '') where system = 'sys_a' and cond = 'clean'
)""",
    "hyp_p as materialized (select utt_id, system, cond, (row_number() over (partition by utt_id, system order by pos) - 1)::int as pos, case when hit then c else 'hyp:UNMAPPED:' || pos end as label, start_us, end_us from h0 where not (hit and c is null))",
    ALIGN.replace("from gold group", "from gold_p group").replace("from hyp h", "from hyp_p h"),
    """nb as (select utt_id, pos, label, lag(label) over w as prev, lead(label) over w as next, start_us, end_us from gold_p window w as (partition by utt_id order by pos)),
er as (
  select s.utt_id, s.system, e.edge, abs(case when e.edge = 'onset' then h.start_us - n.start_us else h.end_us - n.end_us end) as abs_us, coalesce(cn.c, 'silence') as own, case when e.edge = 'onset' then coalesce(cp.c, 'silence') else coalesce(cx.c, 'silence') end as other
  from steps s join nb n on n.utt_id = s.utt_id and n.pos = s.g join hyp_p h on h.utt_id = s.utt_id and h.system = s.system and h.pos = s.h
  left join mn cn on cn.l = n.label left join mn cp on cp.l = n.prev left join mn cx on cx.l = n.next left join mn ch on ch.l = h.label, (values ('onset'), ('offset')) e(edge)
  where coalesce(cn.c, 'silence') = coalesce(ch.c, 'silence')
),
v as (select *, own = 'silence' or other = 'silence' as s from er)""",
    select=f"""select system as source, sum((not s)::bigint)::bigint as n_interior, sum(s::bigint)::bigint as n_edge, {A.mean_ms('case when not s then abs_us end')} as interior_mae, {A.mean_ms('case when s then abs_us end')} as edge_mae,
  {A.div('sum(s::bigint)', 'count(*)', '100.0::double')} as pct_edge, count(distinct utt_id) as n_utts, count(*) as n from v group by system""", recursive=True,
)

QUERIES = {"forced_label_source": (forced_source, SQL)}
