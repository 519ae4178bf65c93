"""Queries over quality gates, tracks and the contract for systems under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as Q
from ..operators import metrics as M
from ..operators import scoring as S
from ..operators import systems as Y
from ..operators import sweep as W
from ..operators import tiers as T
from ..sources import ingest as I
from ..sources.results import Files
from ..sources.storage import scratch_path, stage
from . import alignment as A
from . import fixtures as fx
from .fixture_sql import GOLD, HYP, hash32, with_
from .reports import lb, lb_sql, waves

#: Embeddings as recordings at 100 Hz; their reference has an interval every 80 ms.
RATE, SIZE, HOP, TILE_US, PAD_US = 100, 8, 2, 80_000, 60_000


def plausibility(spark, sf_dir):
    w = waves(spark, sf_dir).where("size(samples) >= 8")
    t = w.select("vec_id", F.explode(F.sequence(F.lit(0), (F.size("samples") / 8).cast("int") - 1)).alias("pos"))
    t = t.select("vec_id", "pos", (F.col("pos") * TILE_US).cast("bigint").alias("start_us"), ((F.col("pos") + 1) * TILE_US).cast("bigint").alias("end_us"))
    silent = fx.hash32(fx.text("sil:", F.col("vec_id"), ":", F.col("pos"))) % 3 == 0
    return Q.plausibility(w, t, ["vec_id"], silent, fx.hash32, RATE, SIZE, HOP, PAD_US)


_STEP = "abs(list_avg(e[f + 1:f + 3]) - list_avg(e[f - 2:f]))"
PLAUSIBLE_SQL = f"""with w as (
  select vec_id, len(embedding) // 8 as k, list_transform(range(0, (len(embedding) - 8) // 2 + 1), lambda f: 10 * log10(list_sum(list_transform(embedding[f * 2 + 1:f * 2 + 8], lambda x: x::double * x::double)) / 8 + 1e-10::double)) as e
  from embeddings where len(embedding) >= 8
),
t as (select vec_id, e, k * 80000 as dur, p, {hash32("'sil:' || vec_id || ':' || p")} % 3 = 0 as s from w, lateral (select unnest(range(k)) as p) z),
o as (select *, s <> coalesce(lag(s) over (partition by vec_id order by p), true) as turn from t),
a as (select vec_id, e, p * 80000 * 100 // 2000000 as f from o where turn),
sa as (select vec_id, {_STEP} as d from a where f >= 3 and f + 3 < len(e)),
na as (select vec_id, any_value(dur) as dur, any_value(e) as e, coalesce((select count(*) from sa where sa.vec_id = t.vec_id), 0) as n from t group by vec_id),
b as (select vec_id, e, (50000 + {hash32("'pl:' || vec_id || ':' || i")} % (dur - 100000)) * 100 // 2000000 as f from na, lateral (select unnest(range(1, greatest(10, n) + 1)) as i) z where dur > 100000),
sb as (select vec_id, {_STEP} as d from b where f >= 3 and f + 3 < len(e)),
ma as (select vec_id, avg(d) as m from sa group by vec_id), mb as (select vec_id, avg(d) as m from sb group by vec_id)
select na.vec_id, n as n_boundaries, round(ma.m, 6) as step_db, round(mb.m, 6) as baseline_db, ma.m > mb.m + 3 as plausible from na left join ma using (vec_id) left join mb using (vec_id)"""


def gaps(spark, sf_dir):
    """Utterance sets of systems by condition, as hypotheses of a sixth of the speakers are left out for one system under noise."""
    return Q.coverage_gaps(_thinned(spark, sf_dir), "speaker_id", "split")


def _thinned(spark, sf_dir):
    h = fx.hyp(spark, sf_dir).where(~((F.col("system") == "sys_b") & (F.col("cond") == "noise") & (fx.hash32(fx.text("out:", F.col("speaker_id"))) % 6 == 0)))
    return h.select("speaker_id", F.concat_ws("_", "system", "cond").alias("split"))


_THIN = f"t as (select distinct speaker_id, system || '_' || cond as split from hyp where not (system = 'sys_b' and cond = 'noise' and {hash32(chr(39) + 'out:' + chr(39) + ' || speaker_id')} % 6 = 0))"
GAPS_SQL = with_(GOLD, HYP, _THIN, select="select m.speaker_id, s.split from (select distinct speaker_id from t) m, (select distinct split from t) s except select * from t")


def gaps_summary(spark, sf_dir):
    return Q.coverage_summary(_thinned(spark, sf_dir), "speaker_id", "split")


SUMMARY_SQL = with_(GOLD, HYP, _THIN, select="select count(*) as n_splits, max(len(m))::bigint as n_most, count(distinct m) <= 1 as same from (select split, list(speaker_id order by speaker_id) as m from t group by split) x")


def linked(spark, sf_dir):
    """Degraded media of every utterance but each seventh turn; first turns need none."""
    g = fx.gold(spark, sf_dir).select("utt_id").distinct()
    media = g.where(fx.hash32(fx.text("media:", F.col("utt_id"))) % 7 != 0)
    return Q.link_degraded(g, media, F.col("utt_id").rlike("_0_[0-9]+$")).groupBy("state").agg(F.count("*").alias("n"))


LINKED_SQL = with_(
    GOLD, f"g as (select distinct utt_id, {hash32(chr(39) + 'media:' + chr(39) + ' || utt_id')} % 7 <> 0 as has from gold)",
    select="select case when has then 'linked' when regexp_matches(utt_id, '_0_[0-9]+$') then 'excluded' else 'missing' end as state, count(*) as n from g group by 1",
)


#: Files as they lie where systems are kept: a recipe for each but sys_d, under its own name or its folder's; logs of sys_c and of sys_d lie under either track.
SYSTEM_FILES = {
    "aligners/sys_a/config.yaml": "name: sys_a\nmode: given\n", "aligners/base/v1.2/config.yaml": "# older\nname: 'sys_b'  # as rows name it\n", "timestamp_asrs/sys_c/config.yaml": "mode: decode\n",
    "aligners/sys_c/log/dev.log": "ran", "timestamp_asrs/sys_d/log/dev.log": "ran", "timestamp_asrs/sys_d/en/config.yaml": "name: sys_e\n",
}


def system_tracks(spark, systems):
    """The track of each of ``systems(system)`` by what lies in a folder that is written first."""
    folder = scratch_path(spark, "systems")
    files = Files(spark, folder)
    for name, text in SYSTEM_FILES.items():
        files.create(f"{files.root}/{name}", text)
    recipes = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "config.yaml").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return W.tracks(systems, I.listing(spark, folder), recipes)


def kinds(table):
    """``table(system, ...)`` with the system's track."""
    found = stage(system_tracks(table.sparkSession, table.select("system").distinct()), "tracks")
    return table.join(found.select("system", "kind"), "system", "left")


def tracks(spark, sf_dir):
    """The track of the systems that errors name, of one that has logs only, and of one that has nothing."""
    names = fx.hyp(spark, sf_dir).select("system").unionAll(spark.sql("values ('sys_d'), ('sys_e')"))
    t = system_tracks(spark, names).join(fx.hyp(spark, sf_dir).groupBy("system").agg(F.count("*").alias("n")), "system", "left")
    return t.select("system", "kind", "origin", F.coalesce("n", F.lit(0)).alias("n"))


TRACKS_SQL = with_(
    GOLD, HYP, "t(system, kind, origin) as (values ('sys_a', 'aligners', 'recipe'), ('sys_b', 'aligners', 'recipe'), ('sys_c', 'timestamp_asrs', 'recipe'), ('sys_d', 'timestamp_asrs', 'folder'), ('sys_e', 'aligners', 'default'))",
    select="select t.*, count(hyp.utt_id) as n from t left join hyp using (system) group by all",
)


def sweep(spark, sf_dir):
    """A sweep over cells that end in every way: what each says of itself, and how many records it wrote."""
    from ..sources import results as R

    h = fx.hyp(spark, sf_dir)
    path = scratch_path(spark, "sweep")

    def plan(system, cond):
        if system == "sys_x":
            raise ValueError("no such system")
        rows = h.where((F.col("system") == system) & (F.col("cond") == cond))
        if system == "sys_c" and cond == "noise":
            return rows.withColumn("label", F.raise_error(F.lit("out of order")))
        return rows.where("pos < 0") if system == "sys_b" and cond == "noise" else rows

    cells = [((s, c), lambda s=s, c=c: plan(s, c)) for s in (*fx.SYSTEMS, "sys_x") for c, _ in fx.CONDITIONS]
    status = W.run_sweep(spark, cells, ["system", "cond"], lambda rows, name: R.publish(spark, f"{path}/{name[0]}-{name[1]}", {"hyp": R.Part(rows)}))
    return status.select("system", "cond", "status", "records", (F.col("seconds") >= 0).alias("timed"), F.col("error").isNotNull().alias("said"))


SWEEP_SQL = with_(
    GOLD, HYP, "c as (select system, cond, count(*) as n from hyp group by all)",
    select="""select system, cond, case when system = 'sys_c' and cond = 'noise' then 'FAIL' when system = 'sys_b' and cond = 'noise' then 'EMPTY' else 'OK' end as status,
  case when system in ('sys_b', 'sys_c') and cond = 'noise' then 0 else n end as records, true as timed, system = 'sys_c' and cond = 'noise' as said from c
union all select 'sys_x', cond, 'CONFIG_FAIL', 0, true, true from (values ('clean'), ('noise')) v(cond)""",
)


def by_track(spark, sf_dir):
    """Places inside each track: systems that are given the transcript never rank against those that decode."""
    return Q.rank_within(kinds(lb(spark, sf_dir)).select("kind", "corpus", "cond", "system", "mae_ms"), ["kind", "corpus", "cond"], "mae_ms")


TRACK_SQL = lb_sql(
    "select kind, corpus, cond, system, mae_ms, case when mae_ms is not null then rank() over (partition by kind, corpus, cond order by mae_ms nulls last) end::int as place from (select *, case when system = 'sys_c' then 'timestamp_asrs' else 'aligners' end as kind from lb) x"
)


def known_answers(spark, sf_dir):
    """A system that is the reference 10 ms late, whole, and one that lacks every fifth interval: mean error 10, all within 20 ms, recall as constructed."""
    g = fx.gold(spark, sf_dir)
    late = T.shift(g, 10_000).withColumns({"cond": F.lit("clean"), "conf": F.lit(None).cast("double")})
    both = late.withColumn("system", F.lit("late")).unionByName(late.where("pos % 5 <> 4").withColumn("system", F.lit("lossy")))
    a = S.align(g, both)
    keys = ["system"]
    rates = M.edit_rates(S.counters(a).select("*"), keys).select("system", "n_gold", "n_hyp", "arr")
    pool = S.boundary_errors(a, A.classify).groupBy(*keys).agg(M.mean_ms(F.col("abs_us")).alias("mae_ms"), M.share(F.col("abs_us") <= 20_000).alias("ta_20ms"))
    return rates.join(pool.where("system = 'late'"), "system", "left")


KNOWN_SQL = with_(
    GOLD,
    select="""select 'late' as system, count(*) as n_gold, count(*) as n_hyp, 1.0::double as arr, 10.0::double as mae_ms, 1.0::double as ta_20ms from gold
union all select 'lossy', count(*), count(*) filter (pos % 5 <> 4), round(count(*) filter (pos % 5 <> 4)::double / count(*), 9), null, null from gold""",
)


def pause_errors(spark, sf_dir):
    """Word errors inside and beside pauses: silence tokens go first; an edge is beside a pause if it is the tier's or its gap is over 1 ms."""
    columns = ("system", "cond", "abs_us", "paused")
    found = S.error_batches(columns, A.class_of, gap_us=1_000)
    e = fx.over_pairs(spark, sf_dir, lambda batches: found(A.word_batches(batches)), S.errors_schema(columns))
    return M.edge_split(e.withColumnRenamed("paused", "silence_adjacent"), ["system", "cond"])


_WORDS = A.WORD_SQL[: A.WORD_SQL.rindex("\nselect * exclude (per)")]
PAUSE_SQL = f"""{_WORDS},
nb as (select utt_id, pos, coalesce(start_us - lag(end_us) over w > 1000, true) as before, coalesce(lead(start_us) over w - end_us > 1000, true) as after from gold_c window w as (partition by utt_id order by pos)),
f as (select e.system, e.cond, e.abs_us, case when e.edge = 'onset' then before else after end as s from errs e join nb on nb.utt_id = e.utt_id and nb.pos = e.gold_idx)
select system, cond, sum((not s)::bigint)::bigint as n_interior, sum(s::bigint)::bigint as n_edge, {A.mean_ms('case when not s then abs_us end')} as interior_mae, {A.mean_ms('case when s then abs_us end')} as edge_mae,
  {A.div('sum(s::bigint)', 'count(*)', '100.0::double')} as pct_edge from f group by all"""


def even_words(item):
    """A stand-in system: the transcript's words at equal lengths. It can't do with one word."""
    words = item["transcript"].split(" ")
    if len(words) < 2:
        raise ValueError("one word")
    each = item["dur_us"] // len(words)
    return [(w, i * each, (i + 1) * each, None) for i, w in enumerate(words)], {"n": str(len(words))}


def run_system(spark, sf_dir):
    """What a system answers for every utterance, and the items it failed on."""
    g = fx.gold(spark, sf_dir)
    i = T.transcript(g, ["utt_id"]).join(g.groupBy("utt_id").agg(F.max("end_us").alias("dur_us")), "utt_id").select(F.col("utt_id").alias("item_id"), "dur_us", F.col("text").alias("transcript"))
    r = Y.run_system(i, Y.System("even", "aligners", ("words",), Y.one_by_one(even_words)), "words")
    last = F.element_at("words", -1)
    return r.select("item_id", F.coalesce(F.size("words"), F.lit(0)).cast("bigint").alias("n_words"), F.when(F.size("words") > 0, last["end_us"]).alias("end_us"), F.element_at("meta", "n").alias("said"), "error")


SYSTEM_SQL = with_(
    GOLD, "i as (select utt_id as item_id, count(*) as n, max(end_us) as dur_us from gold group by utt_id)",
    select="select item_id, case when n > 1 then n else 0 end as n_words, (case when n > 1 then dur_us // n * n end)::bigint as end_us, case when n > 1 then n::varchar end as said, case when n < 2 then 'ValueError: one word' end as error from i",
)

QUERIES = {
    "system_tracks": (tracks, TRACKS_SQL), "sweep_status": (sweep, SWEEP_SQL),
    "gate_plausibility": (plausibility, PLAUSIBLE_SQL), "coverage_gaps": (gaps, GAPS_SQL), "coverage_summary": (gaps_summary, SUMMARY_SQL), "link_degraded": (linked, LINKED_SQL),
    "rank_by_track": (by_track, TRACK_SQL), "gate_known_answers": (known_answers, KNOWN_SQL), "word_pause_split": (pause_errors, PAUSE_SQL), "run_system": (run_system, SYSTEM_SQL),
}
