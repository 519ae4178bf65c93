"""Queries over noise plans: draws under and over an item, rooms' probabilities and noises, copies of recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mixplan as X
from . import fixtures as fx
from .fixture_sql import hash32, with_
from .reports import PLAN_CTE, pool, utterances

SNRS = {"foreground": [20, 15, 10, 5], "background": [15, 10, 5]}


def items(spark, sf_dir):
    return utterances(spark, sf_dir).withColumnRenamed("utt_id", "item_id")


def noises(spark, sf_dir):
    """The training half of the pool; every third file is a background noise."""
    kind = F.when(fx.hash32(fx.text("kind:", F.col("file"))) % 3 == 0, "background").otherwise("foreground")
    return pool(spark, sf_dir).where("half = 'train'").select("idx", "file", kind.alias("kind"))


def h(*parts: str) -> str:
    return hash32(" || ':' || ".join(parts))


def of(values: list[int], at: str) -> str:
    return f"([{', '.join(map(str, values))}])[(({at}) % {len(values)} + 1)::int]"


NOISES = f"tr as (select idx, file, case when {h(chr(39) + 'kind' + chr(39), 'file')} % 3 = 0 then 'background' else 'foreground' end as kind, count(*) over () as size from pool where half = 'train')"


def background(spark, sf_dir):
    p = noises(spark, sf_dir)
    return X.background_draws(items(spark, sf_dir), p, fx.hash32, p.count(), [0, 1, 2, 3], SNRS["background"])


BACKGROUND_SQL = with_(
    *PLAN_CTE, NOISES,
    f"d as (select utt_id as item_id, n::int as n from utts, range(3) r(n) where n < {of([0, 1, 2, 3], h(chr(39) + 'bgn' + chr(39), 'utt_id'))})",
    f"k as (select *, {h(chr(39) + 'bg' + chr(39), 'item_id', 'n')} % (select max(size) from tr) as idx from d)",
    select=f"select item_id, n, file, 0::bigint as at_us, {of(SNRS['background'], h(chr(39) + 'bgs' + chr(39), 'item_id', 'n'))} as snr_db from k join tr using (idx)",
)


def point(spark, sf_dir):
    p = noises(spark, sf_dir)
    return X.point_noises(items(spark, sf_dir), p, fx.hash32, p.count(), 60, SNRS, 80)


POINT_SQL = with_(
    *PLAN_CTE, NOISES, "u as (select utt_id as item_id, dur_us, dur_us * 60 // 60000000 as most from utts)",
    f"c as (select *, 1 + {h(chr(39) + 'ptn' + chr(39), 'item_id')} % most as many from u where most >= 1 and {h(chr(39) + 'ptp' + chr(39), 'item_id')} % 100 < 80)",
    "d as (select item_id, dur_us, unnest(range(many))::int as n from c)",
    f"k as (select *, {h(chr(39) + 'pt' + chr(39), 'item_id', 'n')} % (select max(size) from tr) as idx from d)",
    f"j as (select k.*, file, kind, count(*) over (partition by item_id, kind order by n) - 1 + {h(chr(39) + 'ptt' + chr(39), 'kind', 'item_id')} as turn from k join tr using (idx))",
    select=f"""select item_id, n, file, (case when kind = 'foreground' then {h(chr(39) + 'pta' + chr(39), 'item_id', 'n')} % (dur_us // 10000 + 1) * 10000 else 0 end)::bigint as at_us,
  case when kind = 'foreground' then {of(SNRS['foreground'], 'turn')} else {of(SNRS['background'], 'turn')} end as snr_db from j""",
)


def in_turn(spark, sf_dir):
    """Noises of every item, levels taking turns over all of them: how often each level of a kind comes, and which item has which."""
    p = noises(spark, sf_dir)
    d = X.point_noises(items(spark, sf_dir), p, fx.hash32, p.count(), 60, SNRS, 80).drop("snr_db").join(p.select("file", "kind").distinct(), "file")
    return X.levels_in_turn(d, SNRS, fx.hash32).select("item_id", "n", "kind", "snr_db")


TURN_SQL = with_(
    *PLAN_CTE, NOISES, "u as (select utt_id as item_id, dur_us, dur_us * 60 // 60000000 as most from utts)",
    f"c as (select *, 1 + {h(chr(39) + 'ptn' + chr(39), 'item_id')} % most as many from u where most >= 1 and {h(chr(39) + 'ptp' + chr(39), 'item_id')} % 100 < 80)",
    "d as (select item_id, unnest(range(many))::int as n from c)",
    f"k as (select *, {h(chr(39) + 'pt' + chr(39), 'item_id', 'n')} % (select max(size) from tr) as idx from d)",
    f"j as (select k.*, kind, row_number() over (partition by kind order by {h(chr(39) + 'u' + chr(39), '0', chr(39) + 'turn' + chr(39), 'item_id', 'n')}, item_id, n) - 1 as turn from k join tr using (idx))",
    select=f"select item_id, n, kind, case when kind = 'foreground' then {of(SNRS['foreground'], 'turn')} else {of(SNRS['background'], 'turn')} end as snr_db from j",
)


def isotropic(spark, sf_dir):
    """Items stand in a room by hash; suppliers are recordings of rooms from number 5 on, so that five rooms have none."""
    i = items(spark, sf_dir).withColumn("room", (fx.hash32(fx.text("room:", F.col("item_id"))) % 25).cast("int"))
    s = fx.table(spark, sf_dir, "supplier")
    n = s.select((F.col("s_nationkey") + 5).cast("int").alias("room"), fx.text("iso", F.col("s_suppkey")).alias("file"))
    return X.isotropic_noises(i, n, fx.hash32, SNRS["background"], 90)


ISOTROPIC_SQL = with_(
    *PLAN_CTE, f"i as (select utt_id as item_id, {h(chr(39) + 'room' + chr(39), 'utt_id')} % 25 as room from utts)",
    "f as (select s_nationkey + 5 as room, list('iso' || s_suppkey order by 'iso' || s_suppkey) as files from supplier group by 1)",
    select=f"""select item_id, files[({h(chr(39) + 'iso' + chr(39), 'item_id')} % len(files) + 1)::int] as file, 0::bigint as at_us, {of(SNRS['background'], h(chr(39) + 'iss' + chr(39), 'item_id'))} as snr_db
from i join f using (room) where {h(chr(39) + 'isp' + chr(39), 'item_id')} % 100 < 90""",
)


def room_probabilities(spark, sf_dir):
    """Impulse responses (suppliers) of two sets, the second without a probability of its own; every third response has none either. A room's is their sum."""
    sets = X.smooth_probabilities(spark.createDataFrame([(1, 0, 0.7), (1, 1, None)], "one int, set int, probability double"), ["one"]).select("set", F.col("probability").alias("of_set"))
    s = fx.table(spark, sf_dir, "supplier").withColumn("set", (F.col("s_suppkey") % 2).cast("int"))
    n = s.groupBy("set").agg(F.count("*").alias("n"))
    given = F.when(F.col("s_suppkey") % 3 != 0, (F.col("s_suppkey") % 4 + 1) / (F.col("n") * 4))
    m = s.join(n, "set").join(sets, "set").select("set", "of_set", "s_nationkey", given.alias("probability"))
    m = X.smooth_probabilities(m, ["set"], 0.3, F.col("of_set"))
    return m.groupBy(fx.text("room", F.col("s_nationkey")).alias("room")).agg(F.count("*").alias("n"), F.round(F.sum("probability"), 9).alias("probability"))


ROOM_SQL = """with s as (select s_nationkey, s_suppkey % 2 as st, case when s_suppkey % 3 <> 0 then (s_suppkey % 4 + 1)::double / (count(*) over (partition by s_suppkey % 2) * 4) end as p from supplier),
a as (select *, coalesce(sum(p) over w, 0) as given, count(*) filter (p is null) over w as opened from s window w as (partition by st)),
b as (select *, case when opened > 0 and given < 1 then (1 - given) / opened else 0 end as even from a),
c as (select *, coalesce(0.7::double * p + 0.3::double * even, even) as q from b),
d as (select *, q / sum(q) over (partition by st) * case when st = 0 then 0.7::double else 0.3::double end as r from c)
select 'room' || s_nationkey as room, count(*) as n, round(sum(r), 9) as probability from d group by s_nationkey"""


def replicas(spark, sf_dir):
    """Three copies of every utterance and the original, ids rewritten alike for utterance and speaker, then a suffix on the utterance."""
    g = fx.gold(spark, sf_dir).select("utt_id", "speaker_id").distinct().withColumn("original", F.col("utt_id"))
    return X.rekey(X.replicate(g, ["utt_id", "speaker_id"], 3, "rvb", original=True), ["utt_id"], suffix="_x")


REPLICA_SQL = with_(PLAN_CTE[0], select="select 'rvb' || copy || '-' || utt_id || '_x' as utt_id, 'rvb' || copy || '-' || speaker_id as speaker_id, utt_id as original, copy::int as copy from (select distinct utt_id, speaker_id from gold) g, range(4) r(copy)")

QUERIES = {
    "levels_in_turn": (in_turn, TURN_SQL),
    "background_draws": (background, BACKGROUND_SQL), "point_noises": (point, POINT_SQL), "isotropic_noises": (isotropic, ISOTROPIC_SQL), "room_probabilities": (room_probabilities, ROOM_SQL),
    "replicate_recordings": (replicas, REPLICA_SQL),
}
