"""Queries over whole mixes: the manifest, what was achieved, and the recipes' draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as Q
from ..operators import mixplan as X
from ..operators import waveform as W
from ..sources import ingest as I
from . import fixtures as fx
from .fixture_sql import hash32, with_
from .levels import RATE, level_cte, waves
from .noise import h, items, of
from .reports import PLAN_CTE, pool

CONDITIONS = [("clean", None, None), ("next_snr10", "next", 10.0), ("next_snr0", "next", 0.0)]


def wave_items(spark, sf_dir):
    """Every waveform clean and with the next one as noise at two SNRs; recordings lie under three roots."""
    w = waves(spark, sf_dir).select("vec_id", F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("utt_id"), F.concat(F.lit("/root"), (F.col("vec_id") % 3).cast("string"), F.lit("/w"), F.col("vec_id").cast("string"), F.lit(".wav")).alias("path"))
    return X.items(w, spark.createDataFrame(CONDITIONS, "condition string, noise_type string, snr_db double"), 42)


def mixed(spark, sf_dir):
    """item_id, speech, noise, snr_db of the noisy items."""
    w = waves(spark, sf_dir)
    n = w.select((F.col("vec_id") - 1).alias("vec_id"), F.col("samples").alias("noise"))
    i = wave_items(spark, sf_dir).where("noise_type is not null").select("item_id", "vec_id", "snr_db")
    return i.join(w.withColumnRenamed("samples", "speech"), "vec_id").join(n, "vec_id").select("item_id", "speech", "noise", "snr_db")


def manifest(spark, sf_dir):
    i = wave_items(spark, sf_dir)
    offset = (fx.hash32(fx.text("off:", F.col("item_id"))) % 5_000_000).cast("bigint")
    s = i.where("noise_type is not null").select("item_id", F.concat(F.lit("w"), (F.col("vec_id") + 1).cast("string")).alias("file"), offset.alias("offset_us"))
    scales = W.mix(mixed(spark, sf_dir), RATE).select("item_id", "scale")
    return X.plan_table(i, s, scales, I.media_key(F.col("path")))


_MIXED = "m as (select i.item_id, a.embedding as s, b.embedding as n, i.snr_db from items i join embeddings a on a.vec_id = i.vec_id join embeddings b on b.vec_id = i.vec_id + 1 where i.noise_type is not null)"
_ITEMS = "items as (select vec_id, 'w' || vec_id as utt_id, '/root' || vec_id % 3 as root, 'w' || vec_id || '__' || condition as item_id, c.* from embeddings, (values ('clean', null, null), ('next_snr10', 'next', 10.0::double), ('next_snr0', 'next', 0.0::double)) c(condition, noise_type, snr_db))"
_POWER = "list_sum(list_transform({x}, lambda v: v::double * v::double)) / len({x})"
MANIFEST_SQL = with_(
    _ITEMS, _MIXED.replace("select i.item_id,", "select i.item_id, i.vec_id,"), "sig as (select vec_id as id, embedding as s from embeddings)", level_cte("sig"),
    f"p as (select item_id, sqrt(power / pow(10, snr_db / 10) / ({_POWER.format(x='m.n')})) as scale from m join level on level.id = vec_id)",
    select=f"""select item_id, utt_id, condition, noise_type, snr_db, case when noise_type is not null then 'w' || (vec_id + 1) end as noise_source_file,
  case when noise_type is not null then round({hash32(chr(39) + 'off:' + chr(39) + ' || item_id')} % 5000000 / 1e6::double, 6) end as noise_offset_s, round(scale, 8) as noise_scale,
  'a' || substr(sha1(root), 1, 8) || '/' || utt_id || '/' || case when noise_type is null then 'clean' else condition end || '.wav' as mixed_audio_path from items left join p using (item_id)""",
)


def achieved(spark, sf_dir):
    """Whether each mix has the SNR asked for, measured again from mixture less speech. Every seventh is a tenth too loud in its noise, every eleventh a sample short."""
    m = mixed(spark, sf_dir)
    k = fx.hash32(fx.text("fault:", F.col("item_id")))
    w = W.mix(m, RATE).select("item_id", "samples").join(m.select("item_id", "speech", "snr_db"), "item_id")
    loud = F.when(k % 7 == 0, 1.1).otherwise(1.0)
    noise = F.transform(F.arrays_zip("samples", "speech"), lambda x: (x["samples"] - x["speech"]) * loud)
    short = F.when(k % 11 == 0, F.slice("samples", 1, F.size("samples") - 1)).otherwise(F.col("samples"))
    got = W.measure_snr(w.select("item_id", "speech", noise.alias("noise")), RATE).withColumnRenamed("snr_db", "achieved_db")
    lengths = w.select("item_id", "snr_db", F.size("speech").alias("n_clean"), F.size(short).alias("n_mixed"))
    g = Q.snr_gate(lengths.join(got, "item_id"))
    return g.select("item_id", "n_clean", "n_mixed", F.round("error_db", 6).alias("error_db"), "ok")


ACHIEVED_SQL = with_(
    _ITEMS, _MIXED, f"k as (select item_id, len(s) as n, {hash32(chr(39) + 'fault:' + chr(39) + ' || item_id')} as k from m)",
    select="select item_id, n::int as n_clean, (n - (k % 11 = 0)::int)::int as n_mixed, round(case when k % 7 = 0 then 20 * log10(1.1::double) else 0 end, 6) as error_db, k % 11 <> 0 and (case when k % 7 = 0 then 20 * log10(1.1::double) else 0 end) < 0.5::double as ok from k",
)


def babble_recipe(spark, sf_dir):
    """Noises under every utterance as the babble recipe has it: how many, and how loud."""
    p = pool(spark, sf_dir).where("half = 'eval'").select("idx", "file")
    counts, snrs = X.recipe_values("babble", "num_bg_noises"), X.recipe_values("babble", "bg_snrs")
    d = X.background_draws(items(spark, sf_dir), p, fx.hash32, p.count(), counts, snrs)
    return d.groupBy("item_id").agg(F.count("*").alias("n"), F.sum("snr_db").alias("snr_sum"))


_C, _S = X.recipe_values("babble", "num_bg_noises"), X.recipe_values("babble", "bg_snrs")
BABBLE_SQL = with_(
    *PLAN_CTE, f"d as (select utt_id as item_id, n::int as n from utts, range({max(_C)}) r(n) where n < {of(_C, h(chr(39) + 'bgn' + chr(39), 'utt_id'))})",
    select=f"select item_id, count(*) as n, sum({of(_S, h(chr(39) + 'bgs' + chr(39), 'item_id', 'n'))})::bigint as snr_sum from d group by item_id",
)

QUERIES = {"mix_manifest": (manifest, MANIFEST_SQL), "gate_achieved_snr": (achieved, ACHIEVED_SQL), "babble_recipe": (babble_recipe, BABBLE_SQL)}
