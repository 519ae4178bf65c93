"""Active speech levels of waveforms (embeddings at 100 samples a second) and of recordings that come in slices."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import waveform as W
from . import fixtures as fx

RATE = 100
_G = math.exp(-1 / (RATE * W.TIME_CONSTANT))
_HANG = math.ceil(RATE * W.HANGOVER)


def level_cte(signals: str) -> str:
    """level(id, sq, n, power) of ``signals(id, s)``: both smoothers at once by their common impulse response, the hangover as a window, of thresholds equally far below
    their levels the lowest, then the interpolation."""
    return f"""
samples as (select id, i, x, abs(x) as a from (select id, unnest(s)::double as x, generate_subscripts(s, 1) as i from {signals})),
total as (select id, sum(x * x) as sq, count(*) as n from samples group by id),
envelope as (select b.id, b.i, sum({(1 - _G) ** 2!r}::double * (b.i - a.i + 1) * pow({_G!r}::double, b.i - a.i) * a.a) as q from samples a join samples b on a.id = b.id and a.i <= b.i group by b.id, b.i),
held as (select id, i, max(q) over (partition by id order by i rows between {_HANG} preceding and current row) as m from envelope),
reached as (select id, k, count(*) filter (m >= pow(2.0::double, k)) as active from held, range(-{W.BITS}, 0) r(k) group by id, k),
single as (select id, min(k) as k, arg_min(active, k) as active from reached where active > 0 group by id, active::hugeint * (1::hugeint << (2 * (k + {W.BITS}))::int)),
curve as (select id, 10 * log10(sq / active) as l, 10 * log10(sq / active) - 20 * log10(pow(2.0::double, k)) as d from single join total using (id) where sq > 0),
ends as (select id, max(d) filter (d <= {W.MARGIN}) as d0, arg_max(l, d) filter (d <= {W.MARGIN}) as l0, min(d) filter (d > {W.MARGIN}) as d1, arg_min(l, d) filter (d > {W.MARGIN}) as l1 from curve group by id),
level as (
  select id, n, sq, case when sq = 0 then 0 when e.id is null then sq / n when d0 is null then pow(10, l1 / 10) when d1 is null then pow(10, l0 / 10)
    else pow(10, (l0 + ({W.MARGIN}::double - d0) / (d1 - d0) * (l1 - l0)) / 10) end as power
  from total left join ends e using (id)
)"""


def waves(spark, sf_dir):
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))


def active_speech(spark, sf_dir):
    """Each waveform, every other one with a silent half before it: samples, power and level of what is active."""
    quiet = F.transform("samples", lambda x: F.lit(0.0))
    w = waves(spark, sf_dir).withColumn("samples", F.when(F.col("vec_id") % 2 == 1, F.concat(quiet, "samples")).otherwise(F.col("samples")))
    return W.active_levels(w, ["vec_id"], RATE).select("vec_id", "n_samples", F.round("power", 9).alias("power"), F.round("level_db", 6).alias("level_db"))


_SELECT = "n as n_samples, round(power, 9) as power, round(case when power > 0 then 10 * log10(power) end, 6) as level_db from level"
ACTIVE_SQL = "with sig as (select vec_id as id, case when vec_id % 2 = 1 then list_concat(list_transform(embedding, lambda x: 0::float), embedding) else embedding end as s from embeddings)," + level_cte("sig") + f"\nselect id as vec_id, {_SELECT}"


def recordings(spark, sf_dir):
    """Every eight waveforms in a row are slices of one recording, some of them silent."""
    quiet = F.transform("samples", lambda x: F.lit(0.0))
    w = waves(spark, sf_dir).withColumn("samples", F.when(F.col("vec_id") % 5 == 3, quiet).otherwise(F.col("samples")))
    w = w.select(F.floor(F.col("vec_id") / 8).alias("recording"), (F.col("vec_id") % 8).cast("int").alias("part"), "samples")
    return W.active_levels(w, ["recording"], RATE, "part").select("recording", "n_samples", F.round("power", 9).alias("power"), F.round("level_db", 6).alias("level_db"))


RECORDINGS_SQL = (
    "with part as (select vec_id // 8 as id, vec_id, case when vec_id % 5 = 3 then list_transform(embedding, lambda x: 0::float) else embedding end as s from embeddings),"
    "sig as (select id, flatten(list(s order by vec_id)) as s from part group by id)," + level_cte("sig") + f"\nselect id as recording, {_SELECT}"
)


def by_frames(spark, sf_dir):
    """Waveforms mixed by the level of their loud frames: the scale of the next one's noise at 10 dB."""
    w = waves(spark, sf_dir)
    n = w.select((F.col("vec_id") - 1).alias("vec_id"), F.col("samples").alias("noise"))
    plan = w.join(n, "vec_id").select(F.col("vec_id").cast("string").alias("item_id"), F.col("samples").alias("speech"), "noise", F.lit(10.0).alias("snr_db"))
    return W.mix(plan, RATE, "frames").select("item_id", F.round("scale", 8).alias("scale"), F.round("snr_db", 6).alias("snr_db"))


FRAMES_SQL = f"""with p as (select a.vec_id, a.embedding as s, b.embedding as n from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
f as (select vec_id, list_sum(list_transform(s[2 * k + 1:2 * k + 2], lambda x: x::double * x)) / 2 as p from p, range(32) r(k)),
ps as (select vec_id, avg(p) filter (p >= peak * {W.FRAME_FLOOR}::double) as ps from (select *, max(p) over (partition by vec_id) as peak from f) x group by vec_id)
select vec_id::varchar as item_id, round(sqrt(ps / 10 / (list_sum(list_transform(n, lambda x: x::double * x)) / len(n))), 8) as scale, round(10.0::double, 6) as snr_db from p join ps using (vec_id)"""

QUERIES = {"active_speech_level": (active_speech, ACTIVE_SQL), "recording_speech_level": (recordings, RECORDINGS_SQL), "mix_by_frames": (by_frames, FRAMES_SQL)}
