"""The same interval tables in DuckDB SQL, as common table expressions."""


def hash32(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::bigint"


GOLD = f"""
gold_words as (
  select 'c' || conv_id || '_' || turn || '_' || (w_at // 40) as utt_id, 'spk' || (conv_id % 40) as speaker_id,
    case when role = 'assistant' then 'corpus_b' else 'corpus_a' end as corpus, (w_at % 40)::int as pos, label
  from (select conv_id, turn, role, unnest(toks) as label, generate_subscripts(toks, 1) - 1 as w_at
        from (select *, string_split(trim(regexp_replace(text, '[ \\n\\r\\t]+', ' ', 'g')), ' ') as toks from conversations) s) t
),
gold_durations as (
  select *, 40000 + 10000 * ({hash32("'d:' || utt_id || ':' || pos")} % 20) as dur, case when pos % 7 = 6 then 30000 else 0 end as gap from gold_words
),
gold as materialized (
  select utt_id, speaker_id, corpus, pos, label,
    (sum(dur + gap) over (partition by utt_id order by pos) - dur)::bigint as start_us, (sum(dur + gap) over (partition by utt_id order by pos))::bigint as end_us
  from gold_durations
)"""

HYP = f"""
hyp_raw as (
  select g.*, s.system, c.cond, c.amp, {hash32("s.system || ':' || c.cond || ':' || g.utt_id || ':' || g.pos")} as h
  from gold g, (values ('sys_a'), ('sys_b'), ('sys_c')) s(system), (values ('clean', 1), ('noise', 3)) c(cond, amp)
),
hyp_said as (
  select utt_id, speaker_id, corpus, system, cond, 2 * pos as ord, case when h % 19 = 1 then 'x' || label else label end as label,
    greatest(0, start_us + (((h - h % 7) // 7) % 41 - 20) * 1000 * amp)::bigint as start_us,
    (greatest(0, start_us + (((h - h % 7) // 7) % 41 - 20) * 1000 * amp) + (end_us - start_us))::bigint as end_us, (h % 1000)::double / 1000 as conf
  from hyp_raw where h % 23 <> 0
  union all
  select utt_id, speaker_id, corpus, system, cond, 2 * pos + 1, 'uh', (end_us - 5000)::bigint, end_us, (h % 1000)::double / 1000 from hyp_raw where h % 29 = 2
),
hyp as materialized (
  select utt_id, speaker_id, corpus, system, cond, (row_number() over (partition by utt_id, system, cond order by start_us, ord) - 1)::int as pos, label, start_us, end_us, conf
  from hyp_said
)"""

ERRORS = f"""
errors as materialized (
  select event_type as system, 'u' || user_id as utt_id, case when event_id % 2 = 0 then 'onset' else 'offset' end as edge,
    (round(value * 1000)::bigint * case when event_id % 3 = 0 then -1 else 1 end)::bigint as signed_us, abs(round(value * 1000)::bigint) as abs_us,
    ({hash32("'k:' || event_id")} % 1000)::double / 1000 as conf, event_id % 5 = 0 as silence_adjacent
  from events
)"""

TRACK = """
track as materialized (
  select 'u' || user_id as track, case when event_type = 'error' then 'BREAK' when event_type = 'signup' then 'SIL' else event_type end as label,
    (row_number() over (partition by user_id order by ts, event_id) - 1)::int as pos, epoch_us(ts) as start_us,
    lead(epoch_us(ts)) over (partition by user_id order by ts, event_id) as end_us
  from events
)"""

#: Dynamic programme and traceback over packed pairs: dp, fin, tb, then steps(utt_id, system, cond, g, h), 0-based, null for an indel.
ALIGN = """
packed as materialized (
  select h.utt_id, h.system, h.cond, any_value(g.labels) as a, list(h.label order by h.pos) as b
  from hyp h join (select utt_id, list(label order by pos) as labels from gold group by utt_id) g on g.utt_id = h.utt_id group by h.utt_id, h.system, h.cond
),
dp as (
  select utt_id, system, cond, a, b, 0 as i, list_transform(range(0, len(b) + 1), lambda j: -j)::bigint[] as cur,
    [list_transform(range(0, len(b) + 1), lambda j: -j)::bigint[]] as rows from packed
  union all
  select utt_id, system, cond, a, b, i + 1, nr, list_append(rows, nr) from (
    select *, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j]::bigint[]),
      lambda acc, jj: list_append(acc, greatest(cur[jj[1]] + case when a[i + 1] = b[jj[1]] then 2 else -1 end, cur[jj[1] + 1] - 1, acc[len(acc)] - 1)), [-(i + 1)]::bigint[]) as nr
    from dp where i < len(a)) z
),
fin as materialized (select * from dp where i = len(a)),
tb as (
  select utt_id, system, cond, len(a)::int as i, len(b)::int as j, null::int as g, null::int as h from fin
  union all
  select utt_id, system, cond, case when mv < 2 then i - 1 else i end, case when mv <> 1 then j - 1 else j end, case when mv < 2 then i - 1 end, case when mv <> 1 then j - 1 end
  from (
    select tb.utt_id, tb.system, tb.cond, tb.i, tb.j, case
      when tb.i > 0 and tb.j > 0 and f.rows[tb.i + 1][tb.j + 1] = f.rows[tb.i][tb.j] + case when f.a[tb.i] = f.b[tb.j] then 2 else -1 end then 0
      when tb.i > 0 and f.rows[tb.i + 1][tb.j + 1] = f.rows[tb.i][tb.j + 1] - 1 then 1 else 2 end as mv
    from tb join fin f on f.utt_id = tb.utt_id and f.system = tb.system and f.cond = tb.cond where tb.i > 0 or tb.j > 0) z
),
steps as materialized (select utt_id, system, cond, g, h from tb where g is not null or h is not null)"""


def with_(*parts: str, select: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{','.join(parts)}\n{select}"
