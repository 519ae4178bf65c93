"""Queries over media files that they write first: which file an utterance uses, how long it is, and what commands make of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import ingest as I
from ..sources import media as D
from ..sources.storage import scratch_path, stage
from . import fixtures as fx

#: By supplier: extensions of the files an utterance has. The fifth is of no known format, the last has none.
EXTENSIONS = (("wav",), ("flac",), ("sph", "wav"), ("flac", "sph"), ("mp3",), ())
RATES = (8_000, 16_000, 44_100)


def recorded(spark, sf_dir):
    """Writes the files of every supplier; utterances, the files' paths, and a tier for two thirds of them."""
    s = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    pick = lambda values, by: F.get(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int"))
    lists = F.array(*[F.array(*[F.lit(e) for e in x]).cast("array<string>") for x in EXTENSIONS])
    files = s.withColumn("ext", F.explode(F.get(lists, (F.col("k") % len(EXTENSIONS)).cast("int"))))
    frames = (F.col("k") % 997 * 7 + F.length("ext")).cast("int")
    tone = F.transform(F.sequence(F.lit(1), frames), lambda i: (i % 100 - 50).cast("smallint"))
    folder = scratch_path(spark, "media")
    D.write_media(files.select(F.concat(F.lit("s"), F.col("k").cast("string"), F.lit("."), "ext").alias("name"), pick(RATES, F.col("k")).alias("rate"), tone.alias("samples")), folder).write.format("noop").mode("overwrite").save()
    utts = s.select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("utt_id"))
    tier = s.where("k % 3 <> 0").select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("utt_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("i")).withColumn("end_us", F.col("i") * 1_000_000 + F.length("utt_id"))
    return utts, I.listing(spark, folder).select("path"), tier


def durations(spark, sf_dir):
    """Each utterance's file, what its header says, and the duration it counts as having."""
    utts, files, tier = recorded(spark, sf_dir)
    media = stage(I.resolve_media(utts, files, ("wav", "flac", "sph", "mp3")), "media")
    headers = stage(D.media_headers(media.where("path is not null")), "headers")
    found = D.media_durations(media, headers, tier).join(headers.drop("dur_us"), "path", "left")
    return found.select("utt_id", F.regexp_extract("path", "[^/]+$", 0).alias("file"), "format", "rate", "frames", "state", "dur_us", "origin")


_EXT = "case k % 6 when 0 then 'wav' when 1 then 'flac' when 2 then 'wav' when 3 then 'flac' when 4 then 'mp3' end"
FILES_CTE = f"""a as (select s_suppkey as k, {_EXT} as ext from supplier),
b as (select *, case when k % 6 < 4 then case k % 3 when 0 then 8000 when 1 then 16000 else 44100 end end as rate, case when k % 6 < 4 then k % 997 * 7 + length(ext) end as frames from a)"""
DURATIONS_SQL = f"""with {FILES_CTE}
select 's' || k as utt_id, 's' || k || '.' || ext as file, case when k % 6 < 4 then case ext when 'wav' then 'wave' else 'flac' end end as format, rate::int as rate, frames::bigint as frames,
  case when k % 6 < 4 then 'ok' when k % 6 = 4 then 'unknown' end as state,
  case when k % 6 < 4 then (frames * 2000000 + rate) // (2 * rate) when k % 3 <> 0 then 2000000 + length('s' || k) else 0 end::bigint as dur_us,
  case when k % 6 < 4 then 'header' when k % 3 <> 0 then 'tier' else 'none' end as origin from b"""


def commands(spark, sf_dir):
    """Durations of what commands give, over headers of the files they name; those that name no readable file have none."""
    utts, files, _ = recorded(spark, sf_dir)
    headers = D.media_headers(files).select("path", "dur_us")
    cmd = F.concat(F.col("utt_id"), F.lit(" ffmpeg -nostdin -i '"), "path", F.lit("' -af \"adelay=475|475,apad=pad_dur=0.5\" -f wav - |"))
    plain = F.concat(F.col("utt_id"), F.lit(" "), "path")
    used = I.resolve_media(utts, files, ("sph", "flac", "wav", "mp3")).where("path is not null")
    return I.padded_durations(used.select(F.when(F.length("utt_id") % 2 == 0, cmd).otherwise(plain).alias("value")), headers)


COMMANDS_SQL = """with a as (select s_suppkey as k, case k % 6 when 0 then 'wav' when 1 then 'flac' when 2 then 'sph' when 3 then 'sph' when 4 then 'mp3' end as ext from (select s_suppkey, s_suppkey as k from supplier) x where k % 6 < 5),
b as (select *, case k % 3 when 0 then 8000 when 1 then 16000 else 44100 end as rate, k % 997 * 7 + length(ext) as frames from a)
select 's' || k as key, case when ext <> 'mp3' then ((frames * 2000000 + rate) // (2 * rate) + case when length('s' || k) % 2 = 0 then 975000 else 0 end)::bigint end as dur_us from b"""

QUERIES = {"media_durations": (durations, DURATIONS_SQL), "command_durations": (commands, COMMANDS_SQL)}
