"""Queries over labels, mix plans, waveforms and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.phones import label_map, manner, manner8
from ..operators import labels as L
from ..operators import mixplan as X
from ..operators import reports as R
from ..operators import waveform as W
from . import alignment as A
from . import fixtures as fx
from .fixture_sql import GOLD, HYP, hash32, with_
from .levels import RATE, level_cte, waves

# ---- labels: the letters of every reference word as a phone tier


def letters(spark, sf_dir):
    g = fx.gold(spark, sf_dir)
    p = g.select("utt_id", F.col("pos").alias("word"), F.posexplode(F.regexp_extract_all("label", F.lit("(?s)."), 0)).alias("k", "label"))
    return p.select("utt_id", (F.col("word") * 1000 + F.col("k")).alias("pos"), "label", F.lit("timit61").alias("source"))


_SYMBOLS = "b d g p t k dx ch jh s sh z f th v dh hh m n ng l r w y aa ae ah aw ay eh er ey ih iy ow oy uh uw".split()
LETTERS_CTE = (
    GOLD,
    "letters as (select utt_id, pos * 1000 + k as pos, label from (select utt_id, pos, unnest(string_split(label, '')) as label, generate_subscripts(string_split(label, ''), 1) - 1 as k from gold) x)",
    "lm(key, canonical) as (values " + ", ".join(f"('{s}', '{s}')" for s in _SYMBOLS) + ", ('q', null), ('sil', 'sil'))",
    "canon as (select l.*, m.canonical, case when m.key is null then 'unmapped' when m.canonical is null then 'delete' else 'mapped' end as outcome from letters l left join lm m on m.key = lower(trim(l.label)))",
)


def canonical(spark, sf_dir):
    c = L.canonicalize(letters(spark, sf_dir), label_map(spark))
    return c.groupBy("outcome", "label", "canonical").agg(F.count("*").alias("n"))


CANONICAL_SQL = with_(*LETTERS_CTE, select="select outcome, label, canonical, count(*) as n from canon group by all")


def prepared(spark, sf_dir):
    p = L.prepare_tier(L.canonicalize(letters(spark, sf_dir), label_map(spark)), ["utt_id"])
    return p.groupBy("utt_id").agg(F.count("*").alias("n"), F.max("pos").alias("last"), F.sum(F.startswith("label", F.lit("UNMAPPED:")).cast("bigint")).alias("n_unmapped"))


PREPARED_SQL = with_(*LETTERS_CTE, select="select utt_id, count(*) as n, (count(*) - 1)::int as last, count(*) filter (outcome = 'unmapped') as n_unmapped from canon where outcome <> 'delete' group by utt_id")


def unmapped(spark, sf_dir):
    return L.unmapped_report(L.canonicalize(letters(spark, sf_dir), label_map(spark)), ["source"])


UNMAPPED_SQL = with_(
    *LETTERS_CTE,
    "b as (select label, count(*) as n, row_number() over (order by count(*) desc, label) as rank from canon where outcome = 'unmapped' group by label)",
    "r as (select avg((outcome = 'unmapped')::int) as rate from canon)",
    select="select 'timit61' as source, rank::int as rank, label, n, round(rate, 9) as rate, rate <= 0.01 as ok from b, r where rank <= 15",
)


def inventory(spark, sf_dir):
    return L.inventory(fx.hyp(spark, sf_dir), ["system", "cond"])


INVENTORY_SQL = with_(GOLD, HYP, select="select system, cond, count(distinct label) as n_labels, count(*) as n from hyp group by all")


def manners(spark, sf_dir):
    """Letters by both manner classes."""
    p = L.canonicalize(letters(spark, sf_dir), label_map(spark))
    return p.groupBy(manner(F.col("canonical")).alias("manner"), manner8(F.col("canonical")).alias("manner8")).agg(F.count("*").alias("n"))


MANNERS_SQL = with_(
    *LETTERS_CTE,
    select="""select case when canonical in ('b','d','g','p','t','k') then 'stop' when canonical in ('s','z','f','v') then 'fricative' when canonical in ('m','n') then 'nasal' when canonical in ('l','r','w','y') then 'liquid' else 'silence' end as manner,
case when canonical in ('b','d','g','p','t','k') then 'stop' when canonical in ('s','z') then 'sibilant_affricate' when canonical in ('f','v') then 'fricative' when canonical in ('m','n') then 'nasal' when canonical in ('l','w','y') then 'approximant' when canonical = 'r' then 'rhotic' else 'silence' end as manner8,
count(*) as n from canon group by all""",
)

# ---- mix plans: utterances as items, parts as noise files, suppliers as talkers


def utterances(spark, sf_dir):
    return fx.gold(spark, sf_dir).groupBy("utt_id").agg(F.max("end_us").alias("dur_us"))


def noise_files(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("file"), ((F.col("p_partkey") % 97 + 1) * 100_000).cast("bigint").alias("noise_us"))


NOISE, SNRS = ["noise", "music"], [20, 10]
PLAN_CTE = (
    GOLD, "utts as (select utt_id, max(end_us) as dur_us from gold group by utt_id)",
    "conds(condition, noise_type, snr_db) as (values ('clean', null, null), ('noise_snr20', 'noise', 20.0::double), ('noise_snr10', 'noise', 10.0::double), ('music_snr20', 'music', 20.0::double), ('music_snr10', 'music', 10.0::double))",
    "items as (select utt_id || '__' || condition as item_id, utts.*, conds.* from utts, conds)",
    "files as (select 'n' || p_partkey as file, ((p_partkey % 97 + 1) * 100000)::bigint as noise_us from part)",
    f"pool0 as (select *, row_number() over (order by {hash32(chr(39) + '5:' + chr(39) + ' || file')}, file) - 1 as k, count(*) over () as n from files)",
    "pool as (select file, noise_us, case when k < n // 2 then 'train' else 'eval' end as half, (case when k < n // 2 then k else k - n // 2 end)::bigint as idx from pool0)",
)


def mix_items(spark, sf_dir):
    i = X.items(utterances(spark, sf_dir), X.condition_matrix(spark, NOISE, SNRS), 42)
    return i.select("item_id", "utt_id", "condition", "noise_type", "snr_db", F.col("seed").cast("string").alias("seed"))


ITEMS_SQL = with_(*PLAN_CTE, select="select item_id, utt_id, condition, noise_type, snr_db, (('0x' || substr(sha256('42::' || item_id), 1, 16))::ubigint)::varchar as seed from items")


def pool(spark, sf_dir):
    return X.split_pool(noise_files(spark, sf_dir), "file", fx.hash32, 5)


def noise_pool(spark, sf_dir):
    return pool(spark, sf_dir).select("file", "half", "idx")


POOL_SQL = with_(*PLAN_CTE, select="select file, half, idx from pool")


def mix_sources(spark, sf_dir):
    p = pool(spark, sf_dir).where("half = 'train'").select("idx", "file", "noise_us")
    i = X.items(utterances(spark, sf_dir), X.condition_matrix(spark, NOISE, SNRS), 42).where("noise_type is not null")
    return X.pick_sources(i, p, fx.hash32, p.count()).select("item_id", "file", "offset_us", "tiled")


SOURCES_SQL = with_(
    *PLAN_CTE, "tr as (select *, count(*) over () as size from pool where half = 'train')",
    f"p as (select item_id, dur_us, {hash32(chr(39) + 'src:' + chr(39) + ' || item_id')} % (select max(size) from tr) as idx from items where noise_type is not null)",
    select=f"select item_id, file, (case when noise_us > dur_us then {hash32(chr(39) + 'off:' + chr(39) + ' || item_id')} % (noise_us - dur_us + 1) else 0 end)::bigint as offset_us, noise_us < dur_us as tiled from p join tr using (idx)",
)


def babble(spark, sf_dir):
    t = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("idx"), F.concat(F.lit("spk"), F.col("n_nationkey").cast("string")).alias("talker"))
    return X.pick_babble(utterances(spark, sf_dir).withColumnRenamed("utt_id", "item_id"), t, fx.hash32, 6, t.count())


BABBLE_SQL = with_(
    *PLAN_CTE, "z as (select count(*) as size from nation)", "s as (select n, n * size // 6 as low, (n + 1) * size // 6 as high from z, range(6) r(n))",
    f"t as (select utt_id as item_id, n, low + {hash32(chr(39) + 'bab:' + chr(39) + ' || utt_id || ' + chr(39) + ':' + chr(39) + ' || n')} % (high - low) as idx from utts, s)",
    select="select item_id, string_agg('spk' || idx, '+' order by n) as sources from t group by item_id",
)


def foreground(spark, sf_dir):
    p = pool(spark, sf_dir).where("half = 'train'").select("idx", "file", "noise_us")
    i = utterances(spark, sf_dir).withColumnRenamed("utt_id", "item_id")
    size = p.agg(F.count("*").alias("n"), F.min("noise_us").alias("least")).first()
    return X.foreground_draws(i, p, fx.hash32, size["n"], 500_000, size["least"])


FOREGROUND_SQL = with_(
    *PLAN_CTE, "tr as (select *, count(*) over () as size from pool where half = 'train')",
    f"d as (select utt_id as item_id, dur_us, n, {hash32(chr(39) + 'fg:' + chr(39) + ' || utt_id || ' + chr(39) + ':' + chr(39) + ' || n')} % (select max(size) from tr) as idx from utts, range((select max(dur_us) // (500000 + (select min(noise_us) from tr)) + 1 from utts)) r(n))",
    "a as (select item_id, dur_us, n::int as n, file, coalesce(sum(noise_us + 500000) over (partition by item_id order by n rows between unbounded preceding and 1 preceding), 0)::bigint as at_us from d join tr using (idx))",
    select="select item_id, n, file, at_us from a where at_us < dur_us",
)


def rooms(spark, sf_dir):
    c = fx.table(spark, sf_dir, "nation").select(F.concat(F.lit("rir"), F.col("n_nationkey").cast("string")).alias("choice"), (F.col("n_regionkey") + 1).cast("bigint").alias("weight"))
    return X.weighted_pick(utterances(spark, sf_dir).withColumnRenamed("utt_id", "item_id"), c, fx.hash32).select("item_id", "choice")


ROOMS_SQL = with_(
    *PLAN_CTE, "c as (select 'rir' || n_nationkey as choice, (n_regionkey + 1)::bigint as weight from nation)",
    "k as (select *, sum(weight) over (order by choice)::bigint as hi, sum(weight) over ()::bigint as total from c)",
    f"u as (select utt_id as item_id, {hash32(chr(39) + 'rir:' + chr(39) + ' || utt_id')} as u from utts)",
    select="select item_id, choice from u join k on u % total >= hi - weight and u % total < hi",
)

# ---- waveforms: an embedding is a waveform, its neighbour by number the noise


def wave_frames(spark, sf_dir):
    f = W.frames(waves(spark, sf_dir), ["vec_id"], 16, 8)
    return f.select("vec_id", "frame", "at", F.round("power", 9).alias("power"))


FRAMES_SQL = """select vec_id, f::int as frame, (f * 8)::int as "at", round(list_sum(list_transform(embedding[f * 8 + 1:f * 8 + 16], lambda x: x::double * x::double)) / 16, 9) as power from embeddings, range(7) r(f)"""


def wave_active(spark, sf_dir):
    a = W.active_power(waves(spark, sf_dir), ["vec_id"], 16, 0.25)
    return a.select("vec_id", "n_active", F.round("power", 9).alias("power"))


ACTIVE_SQL = """with f as (select vec_id, list_sum(list_transform(embedding[f * 16 + 1:f * 16 + 16], lambda x: x::double * x::double)) / 16 as p from embeddings, range(4) r(f)),
k as (select *, max(p) over (partition by vec_id) as peak from f)
select vec_id, count(*) as n_active, round(avg(p), 9) as power from k where p >= peak * 0.25 group by vec_id"""


def wave_mix(spark, sf_dir):
    """Each waveform mixed with the next at 10 dB: scale, measured SNR, power of the mixture."""
    w = waves(spark, sf_dir)
    n = w.select((F.col("vec_id") - 1).alias("vec_id"), F.col("samples").alias("noise"))
    plan = w.join(n, "vec_id").select(F.col("vec_id").cast("string").alias("item_id"), F.col("samples").alias("speech"), "noise", F.lit(10.0).alias("snr_db"))
    m = W.mix(plan, RATE)
    power = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x) / F.size("samples")
    return m.select("item_id", F.round("scale", 6).alias("scale"), F.round("snr_db", 6).alias("snr_db"), F.round(power, 6).alias("power"))


MIX_SQL = f"""with sig as (select vec_id as id, embedding as s from embeddings),{level_cte("sig")},
p as (select a.vec_id, a.embedding as s, b.embedding as n from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
q as (select p.*, power as ps, list_sum(list_transform(p.n, lambda x: x::double * x)) / len(p.n) as pn from p join level on level.id = vec_id),
z as (select *, sqrt(ps / 10 / pn) as scale from q)
select vec_id::varchar as item_id, round(scale, 6) as scale, round(10.0::double, 6) as snr_db,
  round(list_sum(list_transform(list_zip(s, n), lambda x: pow(x[1]::double + scale * x[2]::double, 2))) / len(s), 6) as power from z"""

# ---- report tables over the leaderboard


def lb(spark, sf_dir):
    from ..sources.storage import stage

    return stage(A.leaderboard(spark, sf_dir), "leaderboard")


def lb_sql(select: str) -> str:
    return with_(*A.LEADERBOARD_CTE, select=select, recursive=True)


def grid(spark, sf_dir):
    return R.condition_grid(lb(spark, sf_dir), ["corpus", "system"], "mae_ms", ["clean", "noise"])


GRID_SQL = lb_sql("select corpus, system, max(case when cond = 'clean' then mae_ms end) as clean, max(case when cond = 'noise' then mae_ms end) as noise from lb group by all")


def clean_noisy(spark, sf_dir):
    return R.clean_vs_noisy(lb(spark, sf_dir), ["corpus", "system"], ["mae_ms", "per"], ["noise"])


CLEAN_NOISY_SQL = lb_sql(
    "select corpus, system, max(case when cond = 'clean' then mae_ms end) as mae_ms_clean, round(avg(case when cond = 'noise' then mae_ms end), 9) as mae_ms_noisy, max(case when cond = 'clean' then per end) as per_clean, round(avg(case when cond = 'noise' then per end), 9) as per_noisy from lb group by all"
)


def degradation(spark, sf_dir):
    return R.degradation(lb(spark, sf_dir), ["corpus", "system"], "mae_ms", ["clean", "noise"])


DEGRADATION_SQL = lb_sql(
    """select corpus, system, cond, (case when cond = 'clean' then 1 else 2 end)::bigint as step, mae_ms, round(mae_ms / lag(mae_ms) over w, 9) as ratio, coalesce(mae_ms >= lag(mae_ms) over w * 0.85::double, true) as ok
from lb where mae_ms is not null window w as (partition by corpus, system order by cond)"""
)


def transfer(spark, sf_dir):
    return R.transfer(lb(spark, sf_dir), "corpus_a", "corpus_b", ["system", "cond"])


TRANSFER_SQL = lb_sql(
    "select system, cond, a.mae_ms as from_value, b.mae_ms as to_value, round(b.mae_ms - a.mae_ms, 9) as delta, least(a.arr, b.arr) as arr_low, greatest(a.arr, b.arr) as arr_high from lb a join lb b using (system, cond) where a.corpus = 'corpus_a' and b.corpus = 'corpus_b'"
)


def family(spark, sf_dir):
    families = spark.createDataFrame([("sys_a", "first", 1), ("sys_c", "first", 1), ("sys_b", "second", 2)], "system string, family string, family_rank int")
    one = lb(spark, sf_dir).where("corpus = 'corpus_a' and cond = 'clean'").select("system", "mae_ms")
    return R.family_order(one, families, "mae_ms")


FAMILY_SQL = lb_sql(
    "select system, mae_ms, f.family, f.rank::int as family_rank, row_number() over (order by f.rank nulls last, mae_ms desc nulls first, system) as place from lb left join (values ('sys_a', 'first', 1), ('sys_c', 'first', 1), ('sys_b', 'second', 2)) f(system, family, rank) using (system) where corpus = 'corpus_a' and cond = 'clean'"
)


def comparison(spark, sf_dir):
    return R.split_comparison(lb(spark, sf_dir), "mae_ms", ["corpus_a", "corpus_b"], ["sys_c"])


COMPARISON_SQL = lb_sql(
    "select system, cond, max(case when corpus = 'corpus_a' then mae_ms end) as corpus_a, max(case when corpus = 'corpus_b' then mae_ms end) as corpus_b, coalesce(max(case when corpus = 'corpus_a' then mae_ms end), max(case when corpus = 'corpus_b' then mae_ms end)) as value from lb where system <> 'sys_c' group by all"
)


def panel(spark, sf_dir):
    t = A.per_type(spark, sf_dir).where("corpus = 'corpus_a' and cond = 'clean'")
    return R.type_panel(t, ["left_class", "right_class"], ["sys_a", "sys_b", "sys_c"], 50)


PANEL_SQL = with_(
    *A.BASE, A.MATCHED,
    f"t as (select system, left_class, right_class, {A.mean_ms('abs_us')} as mae_ms, count(*) as n from errs where corpus = 'corpus_a' and cond = 'clean' group by all)",
    "c as (select *, printf('%.1f', round(mae_ms, 1)) || case when n < 50 then '*' else '' end as cell from t)",
    select="select left_class, right_class, max(case when system = 'sys_a' then cell end) as sys_a, max(case when system = 'sys_b' then cell end) as sys_b, max(case when system = 'sys_c' then cell end) as sys_c from c group by all", recursive=True,
)


def changes(spark, sf_dir):
    """What publishing sys_b's rates in place of sys_a's would change."""
    e = A.edit_counts(spark, sf_dir)
    from ..sources.storage import stage

    e = stage(e, "rates").select("system", "corpus", "cond", "n_matched", "arr")
    return R.would_change(e.where("system = 'sys_a'").drop("system"), e.where("system = 'sys_b'").drop("system"))


CHANGES_SQL = with_(
    *A.BASE, A.MATCHED,
    f"e as (select corpus, system, cond, sum(n_matched)::bigint as n_matched, {A.div('sum(n_matched)', 'sum(n_gold)')} as arr from counts group by all)",
    "a as (select corpus, cond, n_matched, arr from e where system = 'sys_a')", "b as (select corpus, cond, n_matched, arr from e where system = 'sys_b')",
    select="select *, 'removed' as side from (select * from a except all select * from b) x union all select *, 'added' from (select * from b except all select * from a) y", recursive=True,
)

QUERIES = {
    "canonicalize_labels": (canonical, CANONICAL_SQL), "prepare_tier": (prepared, PREPARED_SQL), "unmapped_report": (unmapped, UNMAPPED_SQL), "label_inventory": (inventory, INVENTORY_SQL), "manner_classes": (manners, MANNERS_SQL),
    "mix_items": (mix_items, ITEMS_SQL), "noise_pool_split": (noise_pool, POOL_SQL), "mix_sources": (mix_sources, SOURCES_SQL), "babble_sources": (babble, BABBLE_SQL), "foreground_draws": (foreground, FOREGROUND_SQL),
    "room_pick": (rooms, ROOMS_SQL), "frame_energy": (wave_frames, FRAMES_SQL), "active_power": (wave_active, ACTIVE_SQL), "mix_waveforms": (wave_mix, MIX_SQL), "condition_grid": (grid, GRID_SQL),
    "clean_vs_noisy": (clean_noisy, CLEAN_NOISY_SQL), "gate_monotone_degradation": (degradation, DEGRADATION_SQL), "register_transfer": (transfer, TRANSFER_SQL), "family_order": (family, FAMILY_SQL),
    "split_comparison": (comparison, COMPARISON_SQL), "type_panel": (panel, PANEL_SQL), "would_change": (changes, CHANGES_SQL),
}
