"""Queries over cells of results on disk, their state, the structure of utterances, side tables and exports. What they read Spark writes from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as Q
from ..operators import metrics as M
from ..operators import scoring as S
from ..operators import tiers as T
from ..sources import ingest as I
from ..sources.storage import scratch_path
from . import alignment as A
from . import fixtures as fx
from .fixture_sql import GOLD, HYP, hash32, with_

G = A.G


def _saved(spark, sf_dir, keep=None) -> str:
    """Hypotheses as compressed JSON lines under one folder a cell: kind, tool, language, corpus, subset, condition. The tasks that make them write them: nothing is shuffled."""
    h = fx.hypotheses(spark, sf_dir)
    h = h if keep is None else h.where(keep)
    path = scratch_path(spark, "cells")
    rows = h.select(F.lit("aligners").alias("kind"), F.col("system").alias("tool"), F.lit("en").alias("lang"), "corpus", F.lit("dev").alias("subset"), F.col("cond").alias("cell_condition"), F.col("utt_id").alias("item_id"), "utt_id", F.lit("given").alias("mode"), "words")
    rows.write.partitionBy(*I.CELL).options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}).json(path)
    return path


def rescore(spark, sf_dir):
    """Every cell found on disk, scored again from the saved hypotheses in one job: counters and rates as on the leaderboard."""
    path = _saved(spark, sf_dir)
    cells = I.list_cells(spark, path)
    items = I.read_cells(spark, path).where("_corrupt is null")
    h = items.select("utt_id", F.col("tool").alias("system"), F.col("cell_condition").alias("cond"), F.col("words.label").alias("hyp"))
    rates = M.edit_rates(S.counted_labels(fx.gold_labels(spark, sf_dir), h), G)
    found = cells.select("corpus", F.col("tool").alias("system"), F.col("cell_condition").alias("cond"), "n_files")
    return found.where("n_files > 0").select(*G).join(rates, G, "left")


def status(spark, sf_dir):
    """The state of every expected cell: one system is never run under noise, another's run there gave no records."""
    gone = (F.col("system") == "sys_b") & (F.col("cond") == "noise")
    have = I.read_cells(spark, _saved(spark, sf_dir, ~gone)).groupBy("tool", "corpus", "cell_condition").agg(F.count("*").alias("n_records"))
    have = have.where("not (tool = 'sys_c' and cell_condition = 'noise')")
    expected = fx.gold(spark, sf_dir).select("corpus").distinct().withColumn("k", F.explode(F.array(*[F.struct(F.lit(s).alias("tool"), F.lit(c).alias("cell_condition")) for s in fx.SYSTEMS for c, _ in fx.CONDITIONS])))
    return Q.cell_status(expected.select("corpus", "k.*"), have, ["tool", "corpus", "cell_condition"])


STATUS_SQL = with_(
    GOLD, HYP, "h as (select system, corpus, cond, count(distinct utt_id) as n from hyp where not (system in ('sys_b', 'sys_c') and cond = 'noise') group by all)",
    select="""select s.system as tool, g.corpus, c.cond as cell_condition, coalesce(n, 0) as n_records, case when n is null then 'empty' else 'done' end as status
from (select distinct corpus from gold) g, (values ('sys_a'), ('sys_b'), ('sys_c')) s(system), (values ('clean'), ('noise')) c(cond) left join h on h.system = s.system and h.corpus = g.corpus and h.cond = c.cond""",
)


def utterances(spark, sf_dir):
    """Utterances, their structure as a whole: durations of 0 or less, overlaps in the strict tier, overlaps in the lenient one, gaps where there may be none, and a covered end off the stated one by over 20 ms."""
    g = fx.gold(spark, sf_dir)
    dur = g.groupBy("utt_id").agg(F.max("end_us").alias("end"))
    n = fx.hash32(fx.text("dur:", F.col("utt_id"))) % 20
    dur = dur.select("utt_id", F.when(n == 0, 0).when(n == 1, F.col("end") + 50_000).when(n == 2, F.col("end") + 20_000).otherwise(F.col("end")).cast("bigint").alias("dur_us"))
    h = fx.hyp(spark, sf_dir).where("system = 'sys_a' and cond = 'clean'")
    found = T.utterance_report(dur, strict=h, lenient=h, tiled=g)
    return found.groupBy("severity", "rule").agg(F.count("*").alias("n"), F.countDistinct("utt_id").alias("n_utts"))


UTTERANCES_SQL = with_(
    GOLD, HYP, f"e as (select utt_id, max(end_us) as e, {hash32(chr(39) + 'dur:' + chr(39) + ' || utt_id')} % 20 as k from gold group by utt_id)",
    "d as (select utt_id, case k when 0 then 0 when 1 then e + 50000 when 2 then e + 20000 else e end as dur from e)",
    "h as (select h.*, dur, lag(end_us) over (partition by h.utt_id order by pos) as before from hyp h join d using (utt_id) where system = 'sys_a' and cond = 'clean')",
    "g as (select g.*, dur, lag(end_us) over (partition by g.utt_id order by pos) as before from gold g join d using (utt_id))",
    """r as (select 'error' as severity, 'no_duration' as rule, utt_id from d where dur <= 0
  union all select 'error', 'strict_overlap', utt_id from h where start_us < before - 100 union all select 'warning', 'lenient_overlap', utt_id from h where start_us < before - 100
  union all select 'error', x.rule, utt_id from h, (values ('strict'), ('lenient')) t(t), lateral (select t || '_negative_start' as rule where start_us < -100 union all select t || '_past_end' where end_us > dur + 100 union all select t || '_not_positive' where end_us <= start_us) x
  union all select 'error', x.rule, utt_id from g, lateral (select 'tiled_negative_start' as rule where start_us < -100 union all select 'tiled_past_end' where end_us > dur + 100 union all select 'tiled_not_positive' where end_us <= start_us union all select 'tiled_overlap' where start_us < before - 100 union all select 'tiled_gap' where start_us > coalesce(before, 0) + 100) x
  union all select 'warning', 'coverage', utt_id from (select utt_id, any_value(dur) as dur, max(end_us) as e from h group by utt_id) c where abs(e - dur) > 20000)""",
    select="select severity, rule, count(*) as n, count(distinct utt_id) as n_utts from r group by all",
)


def distinct_conditions(spark, sf_dir):
    """Pairs of conditions that may share one run: the share of utterances with the same intervals. A third condition is a copy of the noisy one for four in five utterances."""
    h = fx.hyp(spark, sf_dir)
    copied = fx.hash32(fx.text("copy:", F.col("utt_id"))) % 5 != 0
    third = h.where(F.when(copied, F.col("cond") == "noise").otherwise(F.col("cond") == "clean")).withColumn("cond", F.lit("music"))
    return Q.identical_conditions(h.unionByName(third), ["system"], 0.5)


IDENTICAL_SQL = with_(
    GOLD, HYP,
    f"a as (select utt_id, system, cond, pos, label, start_us, end_us from hyp union all select utt_id, system, 'music', pos, label, start_us, end_us from hyp where case when {hash32(chr(39) + 'copy:' + chr(39) + ' || utt_id')} % 5 <> 0 then cond = 'noise' else cond = 'clean' end)",
    "t as (select utt_id, system, cond, list(struct_pack(l := label, s := start_us, e := end_us) order by pos) as t from a group by all)",
    select="""select x.system, x.cond as cond_a, y.cond as cond_b, count(*) as n, count(*) filter (x.t = y.t) as n_same, round(count(*) filter (x.t = y.t)::double / count(*), 9) as share, count(*) filter (x.t = y.t)::double / count(*) < 0.5 as ok
from t x join t y on x.utt_id = y.utt_id and x.system = y.system and x.cond < y.cond group by all""",
)


def ingested(spark, sf_dir):
    """Per corpus: utterances, speakers, intervals, and how many of a system's intervals are in error."""
    g = fx.gold(spark, sf_dir)
    dur = g.groupBy("utt_id").agg(F.max("end_us").alias("dur"))
    h = fx.hyp(spark, sf_dir).where("system = 'sys_b' and cond = 'noise'").join(dur, "utt_id")
    bad = T.violations(h, ["corpus", "utt_id"], F.col("dur"))
    return Q.ingest_summary(g, bad.withColumn("severity", F.when(F.col("rule") == "overlap", "warning").otherwise("error")), "corpus")


INGESTED_SQL = with_(
    GOLD, HYP, "d as (select utt_id, max(end_us) as dur from gold group by utt_id)", "v as (select h.*, dur, lag(end_us) over (partition by h.utt_id order by pos) as before from hyp h join d using (utt_id) where system = 'sys_b' and cond = 'noise')",
    "e as (select corpus, sum((start_us < -100)::int + (end_us > dur + 100)::int + (end_us <= start_us)::int)::bigint as n_errors, sum(coalesce(start_us < before - 100, false)::int)::bigint as n_warnings from v group by corpus)",
    select="select corpus, count(distinct utt_id) as n_utts, count(distinct speaker_id) as n_speakers, count(*) as n_intervals, any_value(coalesce(n_errors, 0)) as n_errors, any_value(coalesce(n_warnings, 0)) as n_warnings from gold left join e using (corpus) group by corpus",
)


def never_scored(spark, sf_dir):
    """The share of each corpus's reference that no system ever matched in a condition, and that a single system left out."""
    g = fx.gold(spark, sf_dir)
    e = S.boundary_errors(S.align(g, fx.hyp(spark, sf_dir)), A.classify).where("edge = 'onset'")
    by = e.groupBy("corpus", "cond", "utt_id", "gold_idx").agg(F.countDistinct("system").alias("k")).groupBy("corpus", "cond").agg(F.count("*").alias("n_scored"), F.sum((F.col("k") == 3).cast("bigint")).alias("n_by_all"))
    n = g.groupBy("corpus").agg(F.count("*").alias("n_gold"))
    return by.join(n, "corpus").select("corpus", "cond", "n_gold", M.ratio(F.col("n_gold") - F.col("n_scored"), "n_gold").alias("never"), M.ratio(F.col("n_gold") - F.col("n_by_all"), "n_gold").alias("not_by_all"))


NEVER_SQL = with_(
    *A.BASE, A.MATCHED, "k as (select corpus, cond, utt_id, gold_idx, count(distinct system) as k from errs where edge = 'onset' group by all)", "n as (select corpus, count(*) as n_gold from gold group by corpus)",
    select=f"select corpus, cond, any_value(n_gold) as n_gold, {A.div('any_value(n_gold) - count(*)', 'any_value(n_gold)')} as never, {A.div('any_value(n_gold) - count(*) filter (k = 3)', 'any_value(n_gold)')} as not_by_all from k join n using (corpus) group by corpus, cond", recursive=True,
)


def speakers(spark, sf_dir):
    """Utterances by what a table of speakers says of them; the table is read as tab-separated text under a comment."""
    g = fx.gold(spark, sf_dir)
    s = g.select("speaker_id").distinct()
    k = fx.hash32(fx.text("who:", F.col("speaker_id")))
    line = F.concat_ws("\t", "speaker_id", F.when(k % 2 == 0, "f").otherwise("m"), F.when(k % 3 == 0, "y").otherwise("o"))
    path = scratch_path(spark, "speakers")
    s.select(line.alias("value")).unionByName(spark.sql("select '# speaker\tsex\tage' as value")).write.text(path)
    t = I.read_speakers(spark, path, "speaker_id string, sex string, age string")
    return Q.strata(g.select("speaker_id", "utt_id").distinct(), t, "speaker_id", ["sex", "age"])


SPEAKERS_SQL = with_(
    GOLD, f"s as (select distinct speaker_id, utt_id, {hash32(chr(39) + 'who:' + chr(39) + ' || speaker_id')} as k from gold)",
    select="select case when k % 2 = 0 then 'f' else 'm' end as sex, case when k % 3 = 0 then 'y' else 'o' end as age, count(distinct speaker_id) as n_speakers, count(*) as n_utts from s group by all",
)


def durations(spark, sf_dir):
    """How long each order's recording is after its command's delay and padding; commands of a path alone have neither, and every 13th medium is missing."""
    o = fx.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    path = F.concat(F.lit("/m/"), k.cast("string"), F.lit(".flac"))
    cmd = F.when(k % 3 == 0, path).otherwise(F.concat(F.lit("ffmpeg -i "), path, F.lit(" -af adelay="), (k % 700).cast("string"), F.when(k % 3 == 1, F.lit(",apad=pad_dur=1.25")).otherwise(""), F.lit(" -f wav - |")))
    media = o.where(k % 13 != 0).select(path.alias("path"), (k % 90_000 * 1000).alias("dur_us"))
    return I.padded_durations(o.select(F.concat(F.lit("u"), k.cast("string"), F.lit(" "), cmd).alias("value")), media)


DURATIONS_SQL = """select 'u' || o_orderkey as key, case when o_orderkey % 13 <> 0 then (o_orderkey % 90000 * 1000 + case when o_orderkey % 3 <> 0 then o_orderkey % 700 * 1000 else 0 end + case when o_orderkey % 3 = 1 then 1250000 else 0 end)::bigint end as dur_us from orders"""


def catalogue(spark, sf_dir):
    """Noise files by kind, with what an annotation says of the music, and how many named files aren't there."""
    p = fx.table(spark, sf_dir, "part")
    kind = F.get(F.array(*[F.lit(x) for x in ("noise", "music", "speech")]), (F.col("p_partkey") % 3).cast("int"))
    files = p.where("p_partkey % 11 <> 0").select(F.concat(F.lit("/pool/"), kind, F.lit("/n"), F.col("p_partkey").cast("string"), F.lit(".wav")).alias("path"))
    notes = p.where("p_partkey % 3 = 1").select(F.concat(F.lit("n"), F.col("p_partkey").cast("string"), F.lit(" some genre "), F.when(F.col("p_partkey") % 2 == 0, "Y").otherwise("N")).alias("value"))
    c = I.noise_catalog(files, notes)
    return c.groupBy("kind", "vocals", "missing").agg(F.count("*").alias("n"))


CATALOGUE_SQL = """with p as (select *, p_partkey % 11 <> 0 as has, p_partkey % 3 = 1 as noted from part)
select case when has then ['noise', 'music', 'speech'][(p_partkey % 3 + 1)::int] else 'music' end as kind, case when noted then p_partkey % 2 = 0 end as vocals, not has as missing, count(*) as n from p where has or noted group by all"""


def exported(spark, sf_dir):
    """The reference as it is exported, an item a line, times in seconds of six digits, and read back; utterances whose words are all hidden aren't in it."""
    g = fx.gold(spark, sf_dir).where(fx.hash32(fx.text("hide:", F.col("utt_id"))) % 9 != 0)
    path = scratch_path(spark, "refs")
    I.export_refs(g.withColumn("level", F.lit("words")), path, ["corpus", "level"])
    r = I.exported(spark, path)
    us = lambda x: F.round(x * 1_000_000).cast("bigint")
    total = F.aggregate("intervals", F.lit(0).cast("bigint"), lambda a, x: a + us(x["end"]) - us(x["start"]))
    return r.groupBy("corpus", "level").agg(F.count("*").alias("n_utts"), F.sum(F.size("intervals")).alias("n"), F.sum(total).alias("total_us"))


EXPORTED_SQL = with_(
    GOLD, select=f"select corpus, 'words' as level, count(distinct utt_id) as n_utts, count(*) as n, sum(end_us - start_us)::bigint as total_us from gold where {hash32(chr(39) + 'hide:' + chr(39) + ' || utt_id')} % 9 <> 0 group by corpus"
)

QUERIES = {
    "rescore_cells": (rescore, A.EDIT_SQL), "cell_status": (status, STATUS_SQL), "utterance_report": (utterances, UTTERANCES_SQL), "gate_identical_conditions": (distinct_conditions, IDENTICAL_SQL), "ingest_summary": (ingested, INGESTED_SQL),
    "never_scored": (never_scored, NEVER_SQL), "speaker_strata": (speakers, SPEAKERS_SQL), "padded_durations": (durations, DURATIONS_SQL), "noise_catalogue": (catalogue, CATALOGUE_SQL), "export_references": (exported, EXPORTED_SQL),
}
