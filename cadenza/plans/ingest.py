"""Queries over readers and the path protocol. The texts they read are made by Spark from the derived tiers, whole."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import pathscore as P
from ..operators import scoring as S
from ..operators import tiers as T
from ..sources import ingest as I
from ..sources import media as D
from ..sources import readers as R
from ..sources.storage import scratch_path, stage
from . import alignment as A
from . import fixtures as fx
from .fixture_sql import GOLD, HYP, hash32, with_

U = ["utt_id"]


def files(rows, line, header=""):
    """files(path, content): an utterance's lines in order under a header."""
    body = F.array_join(F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))["line"], "\n")
    return rows.groupBy("utt_id").agg(F.concat(F.lit(header), body).alias("content")).select(F.concat(F.lit("/aligners/t/en/c/dev/origin/"), "utt_id", F.lit(".txt")).alias("path"), "content")


def sample_tiers(spark, sf_dir):
    g = fx.gold(spark, sf_dir)
    ticks = lambda c: (F.col(c) * 16 / 1000).cast("bigint").cast("string")
    t = I.sample_tiers(files(g, F.concat_ws(" ", ticks("start_us"), ticks("end_us"), "label")), 16_000)
    return t.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("utt_id"), "pos", "label", "start_us", "end_us")


SAMPLE_SQL = with_(GOLD, select="select utt_id, (row_number() over (partition by utt_id order by pos) - 1)::int as pos, label, start_us, end_us from gold where trim(label) <> ''")


def cumulative_tiers(spark, sf_dir):
    g = fx.gold(spark, sf_dir)
    bad = F.when(F.col("pos") % 11 == 5, F.lit("oops")).otherwise(F.format_string("%.6f", F.col("end_us") / 1e6))
    label = F.when(F.col("pos") % 13 == 0, F.lit("")).otherwise(F.col("label"))
    t = I.cumulative_tiers(files(g, F.concat(bad, F.lit(" 121 "), label, F.lit("; a b; a b")), "signal x\nnfields 1\n#\n"))
    return t.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("utt_id"), "pos", "label", "start_us", "end_us")


CUMULATIVE_SQL = with_(
    GOLD, "k as (select utt_id, pos, case when pos % 13 = 0 then '121' when trim(split_part(label, ';', 1)) = '' then '121' else trim(split_part(label, ';', 1)) end as label, end_us from gold where pos % 11 <> 5)",
    select="select utt_id, (row_number() over w - 1)::int as pos, label, coalesce(lag(end_us) over w, 0)::bigint as start_us, end_us from k window w as (partition by utt_id order by pos)",
)


def by_format(spark, sf_dir):
    """Both kinds of tiers written as files of a folder and read by the name of their reader: labels and times of each utterance."""
    g = fx.gold(spark, sf_dir)
    ticks = lambda c: (F.col(c) * 16 / 1000).cast("bigint").cast("string")
    body = lambda line: F.array_join(F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))["line"], "\n")
    folder = scratch_path(spark, "tiers")
    made = g.groupBy("speaker_id").agg(  # a file a speaker
        body(F.concat_ws(" ", ticks("start_us"), ticks("end_us"), "label")).alias("phn"), F.concat(F.lit("x\n#\n"), body(F.concat_ws(" ", F.format_string("%.6f", F.col("end_us") / 1e6), F.lit("121"), F.concat("label", F.lit("; a b"))))).alias("words")
    )
    for kind in ("phn", "words"):
        rows = made.select(F.concat("speaker_id", F.lit(f".{kind}")).alias("name"), F.encode(kind, "utf-8").alias("data"))
        D.write_files(rows, folder).write.format("noop").mode("overwrite").save()
    R.register(spark)
    s = spark.read.format("cadenza_sample_tiers").option("rate", 16_000).option("groupBytes", 100_000).load(folder).drop("pos").withColumn("kind", F.lit("samples"))
    c = spark.read.format("cadenza_cumulative_tiers").load(folder).select("path", "label", "start_us", "end_us", F.lit("cumulative").alias("kind"))
    both = s.unionByName(c).withColumn("speaker_id", F.regexp_extract("path", r"([^/]+)\.[a-z]+$", 1))
    return both.groupBy("kind", "speaker_id").agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_labels"), F.sum("end_us").alias("end_us"))


FORMAT_SQL = with_(
    GOLD, "k as (select speaker_id, label, end_us from gold where trim(label) <> '')",
    "c as (select speaker_id, case when trim(split_part(label, ';', 1)) = '' then '121' else trim(split_part(label, ';', 1)) end as label, end_us from gold)",
    select="""select 'samples' as kind, speaker_id, count(*) as n, count(distinct label) as n_labels, sum(end_us)::bigint as end_us from k group by speaker_id
union all select 'cumulative', speaker_id, count(*), count(distinct label), sum(end_us)::bigint from c group by speaker_id""",
)


def pronunciations(spark, sf_dir):
    """Share of words said as the dictionary has them; one in three loses its first sound."""
    g = fx.gold(spark, sf_dir)
    g = g.withColumn("label", F.replace("label", F.lit(";"), F.lit(":")))
    sounds = F.regexp_replace("label", r"(.)(?=.)", "$1 ")
    said = F.when(F.col("pos") % 3 == 0, F.regexp_replace(sounds, r"^\S+ ", "")).otherwise(sounds)
    w = I.word_pronunciations(I.cumulative_tiers(files(g, F.concat(F.format_string("%.6f", F.col("end_us") / 1e6), F.lit(" 121 "), "label", F.lit("; "), sounds, F.lit("; "), said), "#\n")))
    return w.agg(F.count("*").alias("n"), F.sum(F.col("is_canonical").cast("bigint")).alias("n_canonical"), M.share(F.col("is_canonical")).alias("share"))


PRONUNCIATION_SQL = with_(
    GOLD,
    "w as (select label, pos % 3 <> 0 or length(label) = 1 as same from (select * replace (replace(label, ';', ':') as label) from gold) g where not starts_with(label, '<') and not starts_with(label, '{') and not contains(label, 'U') and trim(label) <> '')",
    select="select count(*) as n, count(*) filter (same) as n_canonical, round(count(*) filter (same)::double / count(*), 9) as share from w",
)


def textgrids(spark, sf_dir):
    g = fx.gold(spark, sf_dir)
    sec = lambda c: F.format_string("%.6f", F.col(c) / 1e6)
    line = F.concat(F.lit("intervals [1]:\n xmin = "), sec("start_us"), F.lit("\n xmax = "), sec("end_us"), F.lit('\n text = "'), F.replace("label", F.lit('"'), F.lit('""')), F.lit('"'))
    t = I.textgrids(files(g, line, 'File type = "ooTextFile"\nitem []:\n item [1]:\n class = "IntervalTier"\n name = "Words"\n'))
    return t.groupBy("tier").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_files"), F.countDistinct("label").alias("n_labels"), F.sum(F.col("end_us") - F.col("start_us")).alias("total_us"))


TEXTGRID_SQL = with_(
    GOLD, "k as (select utt_id, case when trim(split_part(label, ',', 1)) = '' then 'sil' else lower(trim(split_part(label, ',', 1))) end as label, end_us - start_us as d from gold)",
    select="select 'words' as tier, count(*) as n, count(distinct utt_id) as n_files, count(distinct label) as n_labels, sum(d)::bigint as total_us from k",
)


def json_cells(spark, sf_dir):
    """Hypotheses written as partitioned JSON lines and read back with a fixed schema; cells come from the partitions."""
    h = fx.hyp(spark, sf_dir).groupBy("system", "cond", "utt_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct("label", "start_us", "end_us", "conf").alias("x"))))["x"].alias("words"))
    staged = stage(h.select(F.to_json(F.struct("utt_id", "words")).alias("value"), "system", "cond"), "json")
    item = F.from_json("value", f"utt_id string, words {I.INTERVALS}")
    r = staged.withColumn("r", item).select("system", "cond", "r.*")
    return r.groupBy("system", "cond").agg(F.count("*").alias("n_items"), F.sum(F.size("words")).alias("n_intervals"), F.sum(F.aggregate("words", F.lit(0).cast("bigint"), lambda a, x: a + x["end_us"] - x["start_us"])).alias("total_us"))


JSON_SQL = with_(GOLD, HYP, select="select system, cond, count(distinct utt_id) as n_items, count(*) as n_intervals, sum(end_us - start_us)::bigint as total_us from hyp group by all")


def commands(spark, sf_dir):
    """Mixing commands of all orders: how many noises each names, over what SNRs."""
    o = fx.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cmd = F.concat(
        F.lit("utt"), k.cast("string"), F.lit(" wav-reverberate --shift-output=true --additive-signals='"), F.when(k % 3 == 0, F.concat(F.lit('wav-reverberate --duration=3 "/n/a b'), (k % 7).cast("string"), F.lit('.wav" - |,'))).otherwise(""),
        F.lit("/n/m"), (k % 5).cast("string"), F.lit(".wav' --snrs='"), F.when(k % 3 == 0, F.lit("15,")).otherwise(""), (k % 20).cast("string"), F.lit("' --start-times='0'"),
        F.when(k % 4 == 0, F.concat(F.lit(' --impulse-response="sox /r/'), (k % 9).cast("string"), F.lit('.wav -"'))).otherwise(""),
    )
    c = I.mix_commands(o.select(cmd.alias("value")))
    return c.select("key", F.array_join("noises", "|").alias("noises"), F.size("snrs").alias("n_snrs"), F.aggregate("snrs", F.lit(0.0), lambda a, x: a + x).alias("snr_sum"), "rir")


COMMANDS_SQL = """select 'utt' || o_orderkey as key, case when o_orderkey % 3 = 0 then '/n/a b' || o_orderkey % 7 || '.wav|' else '' end || '/n/m' || o_orderkey % 5 || '.wav' as noises,
case when o_orderkey % 3 = 0 then 2 else 1 end as n_snrs, (case when o_orderkey % 3 = 0 then 15 else 0 end + o_orderkey % 20)::double as snr_sum, case when o_orderkey % 4 = 0 then '/r/' || o_orderkey % 9 || '.wav' end as rir from orders"""


def media(spark, sf_dir):
    """The file each utterance uses, of up to three."""
    u = fx.gold(spark, sf_dir).select("utt_id").distinct()
    ext = F.explode(F.array(*[F.lit(e) for e in ("sph", "flac", "wav")]))
    f = u.withColumn("ext", ext).where(fx.hash32(fx.text("m:", F.col("utt_id"), ":", F.col("ext"))) % 3 != 0)
    return I.resolve_media(u, f.select(F.concat(F.lit("/audio/"), "utt_id", F.lit("."), "ext").alias("path")))


MEDIA_SQL = with_(
    GOLD, "u as (select distinct utt_id from gold)",
    f"f as (select utt_id, ext, rank from u, (values ('wav', 1), ('flac', 2), ('sph', 3)) e(ext, rank) where {hash32(chr(39) + 'm:' + chr(39) + ' || utt_id || ' + chr(39) + ':' + chr(39) + ' || ext')} % 3 <> 0)",
    select="select u.utt_id, (select arg_min('/audio/' || f.utt_id || '.' || ext, rank) from f where f.utt_id = u.utt_id) as path from u",
)


def split_applied(spark, sf_dir):
    """Reference tiers of a split list, without prompts that mustn't be scored."""
    g = fx.gold(spark, sf_dir)
    listed = g.select("speaker_id", "utt_id").distinct().where(fx.hash32(F.col("utt_id")) % 4 == 0).select(F.concat("speaker_id", F.lit(" "), "utt_id").alias("value"))
    s = I.split_list(listed.unionAll(spark.sql("select '# a comment' as value")))
    return I.exclude_prompts(I.apply_split(g, s), "_0_[0-9]+$").groupBy("utt_id").agg(F.count("*").alias("n"))


SPLIT_SQL = with_(GOLD, select=f"select utt_id, count(*) as n from gold where {hash32('utt_id')} % 4 = 0 and not regexp_matches(utt_id, '_0_[0-9]+$') group by utt_id")


def merged(spark, sf_dir):
    """Words that end in ``cl`` act as closures, the word after one as its burst where it begins alike; here by label rules over letters."""
    g = fx.gold(spark, sf_dir).withColumn("label", F.when(F.col("pos") % 4 == 1, "tcl").when((F.col("pos") % 4 == 2) & (F.col("pos") % 3 != 0), "t").otherwise(F.col("label")))
    return T.merge_closures(g, U).select("utt_id", "pos", "label", "start_us", "end_us")


MERGED_SQL = with_(
    GOLD,
    "m as (select utt_id, pos, case when pos % 4 = 1 then 'tcl' when pos % 4 = 2 and pos % 3 <> 0 then 't' else label end as label, start_us, end_us from gold)",
    "n as (select *, label = 'tcl' and lead(label) over w = 't' as eats, lead(end_us) over w as nend, lag(label) over w as prev from m window w as (partition by utt_id order by pos))",
    select="select utt_id, (row_number() over (partition by utt_id order by pos) - 1)::int as pos, case when label = 'tcl' then 't' else label end as label, start_us, case when coalesce(eats, false) then nend else end_us end as end_us from n where not (label = 't' and coalesce(prev = 'tcl', false))",
)


#: Tags of every kind, the word in the place of @.
TAGS = ["<LAUGH-@_so>", "<EXT-a=@>", "<laugh=@>", "<IVER-@>", "<EXCLUDE-@>", "<Hes-@-@>", "<NOISE=@_and_@>", "<VOCNOISE>", "<ERROR-@=so>", "<NOISE->", "{B_@}", "<vocnoise-__>", "<EXT-@"]


def tagged(word):
    """A word by its place: plain, or in one of TAGS."""
    k = F.col("pos") % (len(TAGS) + 1)
    return F.coalesce(F.replace(F.get(F.array(*[F.lit(t) for t in TAGS]), (k - 1).cast("int")), F.lit("@"), word), word)


def hidden(spark, sf_dir):
    """Words recovered from tags of every kind, and what disqualifies a segment."""
    g = fx.gold(spark, sf_dir).withColumn("label", tagged(F.regexp_replace("label", "[-_=<>{}]", "x")))
    r = g.withColumns({"word": T.recover_hidden_words(F.col("label")), "bad": T.disqualifies(F.col("label"))})
    return r.groupBy("word", "bad").agg(F.count("*").alias("n"))


HIDDEN_SQL = with_(
    GOLD, "h0 as (select pos, regexp_replace(label, '[-_=<>{}]', 'x', 'g') as w from gold)",
    f"""h as (select w, coalesce(replace({TAGS!r}[(pos % {len(TAGS) + 1})::int], '@', w), w) as label, pos % {len(TAGS) + 1} as k from h0)""",
    select="""select case when k = 1 then w || ' so' when k = 3 then w when k = 6 then w || ' ' || w when k = 7 then w || ' and ' || w end as word,
  regexp_matches(lower(label), 'unknown|cutoff|exclud|excis|error') or k in (2, 9) as bad, count(*) as n from h group by all""",
)


def path_rows(spark, sf_dir):
    return P.paths(A.aligned(spark, sf_dir), S.PAIR)


def path_protocol(spark, sf_dir):
    """The path protocol: boundaries not next to a gap whose classes agree on both sides, pooled per system and condition; and how many each switch recovers."""
    steps = stage(path_rows(spark, sf_dir), "path")
    category = lambda ref, test: (A.classify(ref), A.classify(test))
    pool = P.path_errors(P.agreeing(P.path_boundaries(steps, S.PAIR), category)).groupBy("system", "cond").agg(F.count("*").alias("n"), M.mean_ms(F.col("abs_us")).alias("mae_ms"), M.mean_ms(F.col("signed_us")).alias("signed_ms"))
    wide = P.path_boundaries(steps, S.PAIR, edges=True, gaps=True).groupBy("system", "cond").agg(F.count("*").alias("n_all"), F.sum((F.col("prev_ref") == P.EDGE).cast("bigint")).alias("n_edges"))
    return pool.join(wide, ["system", "cond"])


_ALIGN_K = A.ALIGN.replace("null::int as g, null::int as h from fin", "null::int as g, null::int as h, 0 as k from fin").replace("case when mv <> 1 then j - 1 end\n", "case when mv <> 1 then j - 1 end, k + 1\n").replace("tb.i, tb.j, case", "tb.i, tb.j, tb.k, case")
PATH_SQL = with_(
    GOLD, HYP, _ALIGN_K,
    """ps as materialized (select t.utt_id, t.system, t.cond, t.k, a.label as r, b.label as t, a.start_us as ru, b.start_us as tu from tb t left join gold a on a.utt_id = t.utt_id and a.pos = t.g
  left join hyp b on b.utt_id = t.utt_id and b.system = t.system and b.cond = t.cond and b.pos = t.h where t.g is not null or t.h is not null)""",
    "pw as (select *, lag(r) over w as pr, lag(t) over w as pt, row_number() over w = 1 as first from ps window w as (partition by utt_id, system, cond order by k desc))",
    f"ok as (select * from pw where r is not null and t is not null and not first and pr is not null and pt is not null and {A.cls_sql('r')} = {A.cls_sql('t')} and {A.cls_sql('pr')} = {A.cls_sql('pt')})",
    f"pool as (select system, cond, count(*) as n, {A.mean_ms('abs(tu - ru)')} as mae_ms, {A.mean_ms('tu - ru')} as signed_ms from ok group by all)",
    select="select pool.*, n_all, n_edges from pool join (select system, cond, count(*) as n_all, count(*) filter (first) as n_edges from pw where r is not null and t is not null group by all) w using (system, cond)", recursive=True,
)

def word_tiers(spark, sf_dir):
    """Word tiers in capitals, in folders by speaker: ids come from the path, labels in lower case."""
    g = fx.gold(spark, sf_dir)
    ticks = lambda c: (F.col(c) * 16 / 1000).cast("bigint").cast("string")
    body = F.array_join(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(" ", ticks("start_us"), ticks("end_us"), F.translate("label", string.ascii_lowercase, string.ascii_uppercase)).alias("line"))))["line"], "\n")
    f = g.groupBy("speaker_id", "utt_id").agg(body.alias("content")).select(F.concat(F.lit("/set/"), "speaker_id", F.lit("/"), "utt_id", F.lit(".wrd")).alias("path"), "content")
    return I.word_tiers(f, 16_000).select("utt_id", "pos", "label", "start_us", "end_us")


WORDS_SQL = with_(
    GOLD, select="select speaker_id || '_' || utt_id as utt_id, (row_number() over (partition by utt_id order by pos) - 1)::int as pos, lower(label) as label, start_us, end_us from gold where trim(label) <> ''"
)
PROBES = [(r"/s[0-9]+[.]wav$", 1), (r"[13579][.]wav$", 10), (r"[.]flac$", 1), (r"/nothing/", 0)]


def probes(spark, sf_dir):
    """Files of parts against what a layout should have."""
    f = fx.table(spark, sf_dir, "part").select(F.concat(F.lit("/d/s"), F.col("p_partkey").cast("string"), F.lit(".wav")).alias("path"))
    return I.layout_probe(f, PROBES)


PROBES_SQL = "with f as (select '/d/s' || p_partkey || '.wav' as path from part), p(pattern, least) as (values " + ", ".join(f"('{p}', {n}::int)" for p, n in PROBES) + ") select pattern, count(*) filter (regexp_matches(path, pattern)) as n, least, count(*) filter (regexp_matches(path, pattern)) >= least as ok from p, f group by pattern, least"

def path_cells(spark, sf_dir):
    """Cells under the path protocol: one system's labels fit no mapping, one has onsets only, some hypotheses are missing, one in eleven pairs fails, and so does a whole cell."""
    families = spark.sql("values ('sys_a', 'arpa', false), ('sys_b', 'maps', true) as t(system, family, onsets)")
    gold, hyp = fx.gold(spark, sf_dir), fx.hyp(spark, sf_dir)
    hyp = hyp.where(fx.hash32(fx.text("miss:", F.col("system"), ":", F.col("cond"), ":", F.col("utt_id"))) % 13 != 0)
    failed = (fx.hash32(fx.text("fail:", F.col("utt_id"))) % 11 == 0) | ((F.col("system") == "sys_b") & (F.col("cond") == "noise"))
    wanted = hyp.where(~failed).join(families.select("system", "onsets"), "system")
    wanted = T.onset_only(wanted.where("onsets"), S.PAIR).unionByName(wanted.where("not onsets")).drop("onsets")
    results = stage(P.paths(S.align(gold, wanted), S.PAIR), "path")
    return P.score_cells(results, stage(P.attempts(gold, hyp, ["system", "cond"]), "attempts"), families, lambda ref, test: (A.classify(ref), A.classify(test)), ["system", "cond"])


_THERE = f"{hash32(chr(39) + 'miss:' + chr(39) + ' || system || ' + chr(39) + ':' + chr(39) + ' || cond || ' + chr(39) + ':' + chr(39) + ' || utt_id')} % 13 <> 0"
_BACK = f"({hash32(chr(39) + 'fail:' + chr(39) + ' || utt_id')} % 11 <> 0 and not (system = 'sys_b' and cond = 'noise'))"
PATH_CELLS_SQL = PATH_SQL[: PATH_SQL.index("pool as (")] + f"""pool as (select system, cond, count(*) as n, {A.mean_ms('abs(tu - ru)')} as mae_ms, {A.mean_ms('tu - ru')} as signed_ms from ok where {_THERE} and {_BACK} group by all),
tried as (select distinct system, cond, utt_id from hyp where {_THERE}),
cells as (select system, cond, count(*) as n_attempted, count(*) filter (not {_BACK}) as n_failed from tried group by all)
select system, cond, case when system = 'sys_c' then 'skipped' when n_attempted = n_failed then 'failed' else 'scored' end as state, case when system <> 'sys_c' then n end as n,
  case when system <> 'sys_c' then mae_ms end as mae_ms, case when system <> 'sys_c' then signed_ms end as signed_ms, case when system <> 'sys_c' then n_attempted end as n_attempted, case when system <> 'sys_c' then n_failed end as n_failed
from cells left join pool using (system, cond)"""

QUERIES = {
    "tiers_by_format": (by_format, FORMAT_SQL),
    "path_cells": (path_cells, PATH_CELLS_SQL), "ingest_word_tiers": (word_tiers, WORDS_SQL), "layout_probe": (probes, PROBES_SQL),
    "ingest_sample_tiers": (sample_tiers, SAMPLE_SQL), "ingest_cumulative_tiers": (cumulative_tiers, CUMULATIVE_SQL), "word_pronunciations": (pronunciations, PRONUNCIATION_SQL), "ingest_textgrids": (textgrids, TEXTGRID_SQL),
    "ingest_json_cells": (json_cells, JSON_SQL), "mix_commands": (commands, COMMANDS_SQL), "resolve_media": (media, MEDIA_SQL), "apply_split": (split_applied, SPLIT_SQL), "merge_closures": (merged, MERGED_SQL),
    "recover_hidden_words": (hidden, HIDDEN_SQL), "path_protocol": (path_protocol, PATH_SQL),
}
