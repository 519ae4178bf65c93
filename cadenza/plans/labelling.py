"""Queries over label sources, categories, mapping files and annotation events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phones
from ..operators import labels as L
from ..operators import tiers as T
from ..sources import ingest as I
from . import fixtures as fx
from .fixture_sql import TRACK, hash32, with_

SOURCES = ("timit", "buckeye", "mfa", "ipa")


def quoted(x) -> str:
    return "null" if x is None else "'" + str(x).replace("'", "''") + "'"


def values(rows) -> str:
    return "(values " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


def _spellings() -> dict[str, list[str]]:
    """Each source's labels, and some it doesn't have."""
    return {s: [*phones.sources()[s][0], "?", "zz1"] for s in SOURCES}


def source_labels(spark, sf_dir):
    """Every event as a label of one of four sources: by hash, some in capitals, with blanks around them, or with a stress digit."""
    e = fx.table(spark, sf_dir, "events")
    h = fx.hash32(fx.text("lab:", F.col("event_id")))
    label = F.coalesce(*[F.when(F.col("event_id") % len(SOURCES) == k, F.get(F.array(*[F.lit(x) for x in held]), (h % len(held)).cast("int"))) for k, held in enumerate(_spellings().values())])
    label = F.when(h % 7 == 0, F.upper(label)).when(h % 7 == 1, F.concat(F.lit(" "), label, F.lit(" "))).when(h % 7 == 2, F.concat(label, F.lit("1"))).otherwise(label)
    source = F.get(F.array(*[F.lit(s) for s in SOURCES]), (F.col("event_id") % len(SOURCES)).cast("int"))
    return e.select("event_id", source.alias("source"), label.alias("label"))


def canonical_sources(spark, sf_dir):
    c = L.canonicalize(source_labels(spark, sf_dir), phones.label_map(spark))
    return c.groupBy("source", "label", "outcome", "canonical").agg(F.count("*").alias("n"))


_LISTS = " ".join(f"when event_id % {len(SOURCES)} = {k} then [{', '.join(map(quoted, held))}][({hash32(chr(39) + 'lab:' + chr(39) + ' || event_id')} % {len(held)} + 1)::int]" for k, held in enumerate(_spellings().values()))
LABELS_CTE = (
    f"l0 as (select event_id, [{', '.join(map(quoted, SOURCES))}][(event_id % {len(SOURCES)} + 1)::int] as source, case {_LISTS} end as label, {hash32(chr(39) + 'lab:' + chr(39) + ' || event_id')} as h from events)",
    "l1 as (select event_id, source, case when h % 7 = 0 then upper(label) when h % 7 = 1 then ' ' || label || ' ' when h % 7 = 2 then label || '1' else label end as label from l0)",
)
SOURCES_SQL = with_(
    *LABELS_CTE, f"lm(source, key, canonical) as {values((s, k, v) for s in SOURCES for k, v in phones.sources()[s][0].items())}",
    "k as (select *, case source when 'mfa' then regexp_replace(lower(trim(label)), '[0-2]$', '') when 'timit' then lower(trim(label)) else trim(label) end as key from l1)",
    """c as (select k.source, k.label, case when a.key is not null then a.canonical else b.canonical end as canonical, a.key is not null or b.key is not null as hit
  from k left join lm a on a.source = k.source and a.key = k.key left join lm b on b.source = k.source and b.key = lower(k.key))""",
    select="select source, label, case when not hit then 'unmapped' when canonical is null then 'delete' else 'mapped' end as outcome, canonical, count(*) as n from c group by all",
)


def _pairs() -> tuple[dict, dict]:
    rows = phones.category_rows()
    pick = lambda side, family: [r[2] for r in rows if r[:2] == (side, family)] + ["?", phones.EDGE]
    return {c: pick("ref", c) for c in ("timit", "buckeye")}, {f: pick("test", f) for f in ("arpa", "charsiu", "maps", "bournemouth")}


def categories(spark, sf_dir):
    """Reference and test labels of every event, categorised: how many agree, by corpus, family and categories."""
    (refs, tests), e = _pairs(), fx.table(spark, sf_dir, "events")
    one = lambda kinds, n, tag: F.coalesce(*[F.when(n == k, F.get(F.array(*[F.lit(x) for x in held]), (fx.hash32(fx.text(tag, F.col("event_id"))) % len(held)).cast("int"))) for k, held in enumerate(kinds.values())])
    name = lambda kinds, n: F.get(F.array(*[F.lit(x) for x in kinds]), n.cast("int"))
    corpus, family = F.col("event_id") % 2, F.floor(F.col("event_id") / 2) % 4
    rhotic = F.col("event_id") % 5 == 0
    test = F.when(rhotic & (family == 0), "ER1").otherwise(one(tests, family, "ct:"))
    ref = F.when(rhotic, "r").otherwise(one(refs, corpus, "cr:"))
    p = e.select(name(refs, corpus).alias("corpus"), name(tests, family).alias("family"), ref.alias("ref_label"), test.alias("test_label"))
    return L.categorize(p, phones.category_map(spark)).groupBy("corpus", "family", "ref_cat", "test_cat").agg(F.count("*").alias("n"), F.sum(F.col("agree").cast("bigint")).alias("n_agree"))


def _categories_sql() -> str:
    refs, tests = _pairs()
    one = lambda kinds, n, tag: "case " + " ".join(f"when {n} = {k} then [{', '.join(map(quoted, held))}][({hash32(quoted(tag) + ' || event_id')} % {len(held)} + 1)::int]" for k, held in enumerate(kinds.values())) + " end"
    name = lambda kinds, n: f"[{', '.join(map(quoted, kinds))}][({n} + 1)::int]"
    c, f = "(event_id % 2)", "(event_id // 2 % 4)"
    return with_(
        f"""p as (select {name(refs, c)} as corpus, {name(tests, f)} as family, case when event_id % 5 = 0 then 'r' else {one(refs, c, 'cr:')} end as r,
  case when event_id % 5 = 0 and {f} = 0 then 'ER1' else {one(tests, f, 'ct:')} end as t from events)""",
        f"cm(side, family, label, category) as {values(phones.category_rows())}",
        f"""q as (select p.corpus, p.family, r, t, case when r = '{phones.EDGE}' then 'silence' else coalesce(a.category, 'unknown') end as rc, case when t = '{phones.EDGE}' then 'silence' else coalesce(b.category, 'unknown') end as tc
  from p left join cm a on a.side = 'ref' and a.family = p.corpus and a.label = r left join cm b on b.side = 'test' and b.family = p.family and b.label = t)""",
        "o as (select corpus, family, rc as ref_cat, case when t in ('ER0', 'ER1', 'ER2', 'R') and r in ('axr', 'r', 'er') then rc else tc end as test_cat from q)",
        select="select corpus, family, ref_cat, test_cat, count(*) as n, count(*) filter (ref_cat = test_cat and ref_cat <> 'unknown') as n_agree from o group by all",
    )


def mapping(spark, sf_dir):
    """Mapping files, one a region, of all three kinds of value: nations' keys by name."""
    n, r = fx.table(spark, sf_dir, "nation"), fx.table(spark, sf_dir, "region")
    key = F.col("n_nationkey").cast("string")
    odd = F.col("n_nationkey") % 3
    entry = F.when(odd == 0, F.concat("n_name", F.lit(": k"), key)).when(odd == 1, F.concat("n_name", F.lit(": [a"), key, F.lit(", 'b "), key, F.lit("']"))).otherwise(F.concat("n_name", F.lit(":\n  - c"), key, F.lit("\n  - d"), key))
    lines = n.select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey", entry.alias("entry")).join(r, "r_regionkey")
    files = lines.groupBy("r_name").agg(F.concat(F.lit("# a comment\n\n"), F.array_join(F.array_sort(F.collect_list(F.struct("n_nationkey", "entry")))["entry"], "\n")).alias("content"))
    m = L.read_mapping(files.select(F.col("r_name").alias("path"), "content"))
    return m.select("path", "label", F.array_join("refs", "|").alias("refs"))


MAPPING_SQL = """select r_name as path, n_name as label, case n_nationkey % 3 when 0 then 'k' || n_nationkey when 1 then 'a' || n_nationkey || '|b ' || n_nationkey else 'c' || n_nationkey || '|d' || n_nationkey end as refs
from nation join region on n_regionkey = r_regionkey"""


def tags(t):
    """Annotation as people write it: events in capitals, breaks in brackets, and words the speaker broke off."""
    odd = F.col("pos") % 11
    word = F.when(F.col("label") == "BREAK", "<IVER>").when(F.col("label") == "SIL", "SIL").when(odd == 7, "<CUTOFF-a=b>").when(odd == 4, "<LAUGH-so>").otherwise(F.col("label"))
    return t.withColumn("label", word)


TAGS = "tags as (select track, pos, start_us, end_us, case when label = 'BREAK' then '<IVER>' when label = 'SIL' then 'SIL' when pos % 11 = 7 then '<CUTOFF-a=b>' when pos % 11 = 4 then '<LAUGH-so>' else label end as label from track)"


def classes(spark, sf_dir):
    """How often each label of a track is a break, silence, a marker, disqualifying or no speech, and its name on output."""
    t = tags(fx.track(spark, sf_dir))
    label = F.col("label")
    kinds = {"is_break": T.is_break(label), "is_sil": T.is_sil(label), "is_marker": T.is_marker(label), "is_bad": T.disqualifies(label), "is_nonspeech": T.is_nonspeech(label), "is_real": T.is_real_phone(label)}
    return t.withColumns(kinds).withColumn("written", T.rename_events(label)).groupBy("label", "written", *kinds).agg(F.count("*").alias("n"))


CLASSES_SQL = with_(
    TRACK, TAGS,
    select="""select label, case when label = 'SIL' then '!sil' else label end as written, label = 'SIL' or starts_with(label, '<') as is_break, label = 'SIL' as is_sil, starts_with(label, '<') as is_marker,
  label like '%CUTOFF%' as is_bad, label = 'SIL' or starts_with(label, '<') as is_nonspeech, not (label = 'SIL' or starts_with(label, '<')) as is_real, count(*) as n from tags group by all""",
)


def halves(t):
    """A phone tier: each interval in two, the second in capitals at every fifth place."""
    mid = F.floor((F.col("start_us") + F.col("end_us")) / 2)
    two = F.array(F.struct(F.lit("ah").alias("label"), F.col("start_us").alias("s"), mid.alias("e")), F.struct(F.when(F.col("pos") % 5 == 0, "NOISE").otherwise("t").alias("label"), mid.alias("s"), F.col("end_us").alias("e")))
    return t.where("end_us is not null").select("track", F.posexplode(two).alias("k", "x"), "pos").select("track", (2 * F.col("pos") + F.col("k")).alias("pos"), "x.label", F.col("x.s").alias("start_us"), F.col("x.e").alias("end_us"))


HALVES = """ph as (select track, label, s as start_us, e as end_us from (
  select track, 'ah' as label, start_us as s, (start_us + end_us) // 2 as e from track where end_us is not null
  union all select track, case when pos % 5 = 0 then 'NOISE' else 't' end, (start_us + end_us) // 2, end_us from track where end_us is not null) x)"""
DAY = 86_400_000_000


def native_by_phones(spark, sf_dir):
    """Runs of words between breaks that hold at least five phones, numbered, within recordings that end early; the short ones go and the rest keep their numbers."""
    t = fx.track(spark, sf_dir)
    s = T.segment_native(tags(t), ["track"], T.is_break(F.col("label")), 30 * 60_000_000, 5, halves(t))
    media = t.groupBy("track").agg((F.max("end_us") - DAY).alias("dur_us"))
    return T.clamp_segments(s, media, ["track"])


NATIVE_SQL = with_(
    TRACK, TAGS, HALVES, "n as (select *, label = 'SIL' or starts_with(label, '<') as brk from tags where end_us is not null)", "i as (select *, sum(brk::int) over (partition by track order by pos) as island from n)",
    "r as (select track, island, min(start_us) as s, max(end_us) as e from i where not brk group by all)",
    "c as (select r.track, island, s, e, count(*) as n from r join ph on ph.track = r.track and ph.start_us >= s - 1 and ph.end_us <= e + 1 group by all having count(*) >= 5 and e - s >= 1800000000)",
    "k as (select *, (row_number() over (partition by track order by s, island) - 1)::int as segment from c)", "m as (select track, max(end_us) - 86400000000 as dur from track group by track)",
    "z as (select track, segment, greatest(0, least(s, dur)) as start_us, greatest(0, least(e, dur)) as end_us, n from k join m using (track))",
    select="select track, segment, start_us, end_us, n from z where end_us - start_us >= 100000",
)


def speech_words(spark, sf_dir):
    """Tagged words over which a phone of speech lies, where phones of every third word are missing."""
    t = tags(fx.track(spark, sf_dir)).where("end_us is not null")
    p = halves(fx.track(spark, sf_dir)).where("floor(pos / 2) % 3 <> 0 and (floor(pos / 2) % 5 <> 1 or pos % 2 = 1)")
    return T.words_with_speech(t, p, ["track"]).groupBy("label").agg(F.count("*").alias("n"))


SPEECH_SQL = with_(
    TRACK, TAGS,
    """p as (select track, 'ah' as label, start_us as s, (start_us + end_us) // 2 as e from track where end_us is not null and pos % 3 <> 0 and pos % 5 <> 1
  union all select track, case when pos % 5 = 0 then 'NOISE' else 't' end, (start_us + end_us) // 2, end_us from track where end_us is not null and pos % 3 <> 0)""",
    select="select label, count(*) as n from tags w where end_us is not null and exists (select 1 from p where p.track = w.track and p.label <> 'NOISE' and p.e > w.start_us and p.s < w.end_us) group by label",
)


def gold_guard(spark, sf_dir):
    """Suppliers' paths that name a machine-aligned corpus, by the name found; one name is the caller's own."""
    s = fx.table(spark, sf_dir, "supplier")
    names = ["LibriTTS_R", "LibriSpeech-Alignments", "common_voice_alignments", "CommonVoice", "cmu_arctic", "MFA_aligned", "timit", "buckeye", "own_set"]
    path = F.concat(F.lit("/corpora/"), F.get(F.array(*[F.lit(n) for n in names]), (F.col("s_suppkey") % len(names)).cast("int")), F.lit("/"), F.col("s_suppkey").cast("string"))
    return s.select(I.machine_aligned(path, ("own-set",)).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


GUARD_SQL = """select [ 'libritts', 'librispeech-alignments', 'common-voice-alignments', 'commonvoice', 'cmu-arctic', 'mfa-aligned', null, null, 'own-set'][(s_suppkey % 9 + 1)::int] as name, count(*) as n from supplier group by 1"""


def out_of_range(spark, sf_dir):
    """Intervals outside recordings that are 200 ms shorter than the reference, by more than 50 ms; every 17th begins before the recording."""
    dur = fx.gold(spark, sf_dir).groupBy("utt_id").agg((F.max("end_us") - 200_000).alias("dur"))
    h = fx.hyp(spark, sf_dir).withColumn("start_us", F.when(F.col("pos") % 17 == 3, F.lit(-60_000)).otherwise(F.col("start_us"))).join(dur, "utt_id")
    kept, dropped = T.drop_out_of_range(h, ["utt_id", "system", "cond"], F.col("dur"), 50_000)
    left = kept.groupBy("system", "cond").agg(F.count("*").alias("n_kept"))
    return dropped.groupBy("system", "cond").agg(F.sum("n_dropped").alias("n_dropped"), F.sum((F.col("n_dropped") > 0).cast("bigint")).alias("n_hit")).join(left, ["system", "cond"])


def _range_sql():
    from .fixture_sql import GOLD, HYP

    return with_(
        GOLD, HYP, "d as (select utt_id, max(end_us) - 200000 as dur from gold group by utt_id)",
        "b as (select h.utt_id, system, cond, case when pos % 17 = 3 then -60000 else start_us end < -50000 or start_us > dur + 50000 or end_us > dur + 50000 as bad from hyp h join d using (utt_id))",
        "u as (select system, cond, utt_id, count(*) filter (bad) as n, count(*) filter (not bad) as k from b group by all)",
        select="select system, cond, sum(n)::bigint as n_dropped, count(*) filter (n > 0) as n_hit, sum(k)::bigint as n_kept from u group by all",
    )


QUERIES = {
    "canonical_sources": (canonical_sources, SOURCES_SQL), "category_agreement": (categories, _categories_sql()), "custom_mapping": (mapping, MAPPING_SQL), "label_classes": (classes, CLASSES_SQL),
    "segment_native_phones": (native_by_phones, NATIVE_SQL), "words_with_speech": (speech_words, SPEECH_SQL), "gold_guard": (gold_guard, GUARD_SQL), "out_of_range": (out_of_range, _range_sql()),
}
