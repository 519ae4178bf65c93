"""Known answers for label sources, report tables, gates, side tables and results on disk."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.functions import phones
from cadenza.operators import gates as Q
from cadenza.operators import labels as L
from cadenza.operators import metrics as M
from cadenza.operators import mixplan as X
from cadenza.operators import reports as R
from cadenza.operators import tiers as T
from cadenza.sources import ingest as I
from cadenza.sources import results
from cadenza.sources import storage


def canonical(spark, source, labels):
    t = spark.createDataFrame([(i, x, source) for i, x in enumerate(labels)], "i int, label string, source string")
    return [(r.canonical, r.outcome) for r in L.canonicalize(t, phones.label_map(spark)).orderBy("i").collect()]


def test_sources_fold_as_published(spark):
    assert canonical(spark, "buckeye", ["dx", "nx", "tq", "en", "SIL", "IVER", "AH", "zz"]) == [("dx", "mapped"), ("n", "mapped"), (None, "delete"), ("n", "mapped"), ("sil", "mapped"), (None, "delete"), ("ah", "mapped"), (None, "unmapped")]
    assert canonical(spark, "ipa", ["iː", "tʃ", "ɹ", "ʔ", "", "-", "ʘ"]) == [("iy", "mapped"), ("ch", "mapped"), ("r", "mapped"), (None, "delete"), ("sil", "mapped"), (None, "delete"), (None, "unmapped")]
    assert canonical(spark, "mfa", ["AH0", " ER1 ", "spn", "[UNK]", ""]) == [("ah", "mapped"), ("er", "mapped"), ("sil", "mapped"), (None, "delete"), ("sil", "mapped")]
    assert canonical(spark, "nowhere", ["ah"]) == [(None, "unmapped")]
    with pytest.raises(ValueError):
        phones.sources("uk")
    phones.register_source("own", {"x": "ah"}, accent="test")
    assert phones.label_map(spark, "test").count() == 1
    with pytest.raises(ValueError):
        phones.register_source("own", {}, accent="test")


def test_categories(spark):
    rows = [("timit", "arpa", "axr", "ER1"), ("timit", "arpa", "r", "ER0"), ("timit", "arpa", "aa", "AA2"), ("buckeye", "maps", "SIL", "H#"), ("timit", "arpa", "zz", "zz"), ("timit", "charsiu", phones.EDGE, "[SIL]"), ("buckeye", "bournemouth", "s", "ʃ"), ("timit", "arpa", "s", "F")]
    p = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, corpus string, family string, ref_label string, test_label string")
    got = [(r.ref_cat, r.test_cat, r.agree) for r in L.categorize(p, phones.category_map(spark)).orderBy("i").collect()]
    assert got == [
        ("vowel", "vowel", True), ("approximant", "approximant", True), ("vowel", "vowel", True), ("silence", "silence", True), ("unknown", "unknown", False), ("silence", "silence", True), ("sibilant", "sibilant", True),
        ("sibilant", "fricative", False),
    ]
    keys = [r[:3] for r in phones.category_rows()]
    assert len(keys) == len(set(keys))


def test_mapping_files(spark):
    content = "# c\nTH: th\n'AH 0': [ah, \"ax r\"]\nB:\n  - b\n  - 'bcl'\nEMPTY:\n"
    got = {r.label: r.refs for r in L.read_mapping(spark.createDataFrame([("f", content)], "path string, content string")).collect()}
    assert got == {"TH": ["th"], "AH 0": ["ah", "ax r"], "B": ["b", "bcl"]}


def test_robustness(spark):
    rows = [("a", "clean", 10.0), ("a", "n_snr20", 12.0), ("a", "n_snr10", 20.0), ("b", "clean", 10.0), ("b", "n_snr20", 8.0), ("b", "n_snr10", 30.0), ("c", "n_snr10", 5.0), ("d", "clean", 0.0), ("d", "m_snr10", None)]
    got = {(r.system, r.noise): (r.ratio, r.monotone) for r in R.robustness(spark.createDataFrame(rows, "system string, cond string, mae double"), ["system"], "mae").collect()}
    assert got == {("a", "n"): (2.0, True), ("b", "n"): (3.0, False), ("c", "n"): (None, True), ("d", "m"): (None, True)}
    parts = spark.createDataFrame([("clean",), ("x_y_snr-5",)], "c string").select(*R.condition_parts(F.col("c"))).collect()
    assert [tuple(p) for p in parts] == [("clean", None), ("x_y", -5)]


def test_display(spark):
    t = spark.createDataFrame([("own", 1.0, None, None), ("own_x", 2.345, 1.0, 3.0), ("ownership", 3.0, None, None), ("own_keep", None, 1.0, 2.0)], "system string, v double, lo double, hi double")
    p = R.published(t, ("own",), ("own_keep",), {"ownership": ("v",)})
    got = {r.system: (r.c, r.s) for r in p.select("system", R.interval_cell(F.col("v"), F.col("lo"), F.col("hi")).alias("c"), R.pair_cell(F.col("lo"), F.col("hi"), 1).alias("s")).collect()}
    assert got == {"ownership": ("—", "—/—"), "own_keep": ("— [1.00,2.00]", "1.0/2.0")}
    lb = spark.createDataFrame([("s", "a", 5), ("s", "b", 9), ("t", "a", 3), ("t", "b", 3)], "system string, corpus string, n int")
    assert {(r.system, r.corpus) for r in R.best_covered(lb, ["system"], "corpus", "n").collect()} == {("s", "b"), ("t", "a")}
    assert {r.corpus: r["rank"] for r in R.in_reporting_order(lb, "corpus", ["b"]).collect()} == {"b": 1, "a": 2}


def test_ranks_by_ranges(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([0, 1, 5, 5, 7, rng.randrange(1000)])) for g in "ab" for _ in range(500)]
    got = {(r.g, r.v): (r.c, r["rank"]) for r in M.by_value(spark.createDataFrame(rows, "g string, v int"), ["g"], "v").collect()}
    for g in "ab":
        values = [v for k, v in rows if k == g]
        for v in set(values):
            assert got[g, v] == (values.count(v), sum(x < v for x in values) + (values.count(v) + 1) / 2)


def test_utterance_report(spark):
    tier = lambda rows: spark.createDataFrame([(u, i, a, b) for u, spans in rows.items() for i, (a, b) in enumerate(spans)], "utt_id string, pos int, start_us long, end_us long")
    dur = spark.createDataFrame([("ok", 1_000_000), ("zero", 0), ("short", 900_000), ("gap", 1_000_000)], "utt_id string, dur_us long")
    good = [(0, 500_000), (500_000, 1_000_000)]
    got = {tuple(r) for r in T.utterance_report(dur, strict=tier({"ok": good, "short": good}), lenient=tier({"ok": [(0, 600_000), (500_000, 1_000_000)]}), tiled=tier({"ok": good, "gap": [(1_000, 9), (600_000, 1_000_000)]})).collect()}
    assert got == {
        ("zero", "error", "no_duration"), ("short", "error", "strict_past_end"), ("short", "warning", "coverage"), ("ok", "warning", "lenient_overlap"), ("gap", "error", "tiled_gap"), ("gap", "error", "tiled_not_positive"),
    }
    assert T.utterance_report(dur.where("dur_us > 0")).count() == 0


def test_identical_conditions(spark):
    rows = [(f"u{i}", c, 0, "x", 0, 5 + (c == "n" and i == 0)) for i in range(4) for c in "cnm"]
    got = {(r.cond_a, r.cond_b): (r.n, r.n_same, r.ok) for r in Q.identical_conditions(spark.createDataFrame(rows, "utt_id string, cond string, pos int, label string, start_us int, end_us int").withColumn("s", F.lit(1)), ["s"], 0.9).collect()}
    assert got == {("c", "m"): (4, 4, False), ("c", "n"): (4, 3, True), ("m", "n"): (4, 3, True)}


def test_snr_gate(spark):
    rows = [("a", 10.0, 10.4, 5, 5), ("b", 10.0, 10.6, 5, 5), ("c", 10.0, 10.0, 5, 4), ("d", 10.0, None, 5, 5)]
    assert {r.item_id: r.ok for r in Q.snr_gate(spark.createDataFrame(rows, "item_id string, snr_db double, achieved_db double, n_clean int, n_mixed int")).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_cells_on_disk(spark, tmp_path):
    row = spark.createDataFrame([("aligners", "t", "en", "c", "dev", "clean", "i1"), ("aligners", "t", "en", "c", "dev", "noise", "i1")], "kind string, tool string, lang string, corpus string, subset string, cell_condition string, item_id string")
    row.write.partitionBy(*I.CELL).json(str(tmp_path / "x"))
    cells = I.list_cells(spark, str(tmp_path / "x")).collect()
    assert {(r.tool, r.cell_condition, r.n_files) for r in cells} == {("t", "clean", 1), ("t", "noise", 1)}
    assert I.read_cells(spark, str(tmp_path / "x")).where("cell_condition = 'noise'").select("item_id", "corpus").collect() == [("i1", "c")]


def test_tables_are_replaced_whole(spark, tmp_path):
    path, t = str(tmp_path / "r"), spark.range(3)
    I.replace_table(t, path)
    old = I.current_table(spark, path)
    I.replace_table(spark.range(5), path)
    assert old.count() == 3 and I.current_table(spark, path).count() == 5  # who read the old version still can
    lb = spark.createDataFrame([("b", "s", "c", 1.5), ("a", "s", "c", None)], "corpus string, system string, cond string, mae double")
    I.write_results(lb, lb.withColumns({"left_class": F.lit("x"), "right_class": F.lit("y")}), path)
    now = results.current(spark, path)
    assert [r.corpus for r in now.table("leaderboard").collect()] == ["a", "b"]
    assert now.table("leaderboard_csv").columns == lb.columns and now.table("per_type").count() == 2


def test_exports(spark, tmp_path):
    g = spark.createDataFrame([("u2", 0, "a", 0, 1_234_567, "c"), ("u1", 1, "b", 5, 10, "c"), ("u1", 0, "a", 0, 5, "c")], "utt_id string, pos int, label string, start_us long, end_us long, corpus string")
    I.export_refs(g, str(tmp_path / "e"), ["corpus"])
    rows = {r.utt_id: [tuple(x) for x in r.intervals] for r in I.exported(spark, str(tmp_path / "e")).collect()}
    assert rows == {"u2": [("a", 0.0, 1.234567)], "u1": [("a", 0.0, 0.000005), ("b", 0.000005, 0.00001)]}
    assert {r.utt_id for r in I.first_items(g, 1).collect()} == {"u1"}
    assert I.variant_key(a=1, b="x") == I.variant_key(b="x", a=1) != I.variant_key(a=2, b="x")
    keys = spark.createDataFrame([("/a/b/1.wav",), ("/a/b/2.wav",), ("/a/c/1.wav",)], "p string").select(I.media_key(F.col("p"))).collect()
    assert keys[0] == keys[1] != keys[2] and len(keys[0][0]) == 9


def test_side_tables(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("# who\tsex\nS1\tf\nS2\tm\n")
    s = I.read_speakers(spark, str(tmp_path / "s.tsv"), "speaker_id string, sex string")
    assert {tuple(r) for r in s.collect()} == {("S1", "f"), ("S2", "m")}
    m = spark.createDataFrame([("S1", "u1"), ("S1", "u2"), ("S2", "u3"), ("S9", "u4")], "speaker_id string, utt_id string")
    assert {tuple(r) for r in Q.strata(m, s, "speaker_id", ["sex"]).collect()} == {("f", 1, 2), ("m", 1, 1)}
    cmd = spark.createDataFrame([("u1 ffmpeg -i /a.flac -af adelay=250,apad=pad_dur=1.5 - |",), ("u2 /b.wav |",), ("u3 /none.wav",)], "value string")
    media = spark.createDataFrame([("/a.flac", 1_000_000), ("/b.wav", 5)], "path string, dur_us long")
    assert {r.key: r.dur_us for r in I.padded_durations(cmd, media).collect()} == {"u1": 2_750_000, "u2": 5, "u3": None}
    files = spark.createDataFrame([("/m/music/a.wav",), ("/m/noise/b.wav",)], "path string")
    notes = spark.createDataFrame([("a pop Y",), ("z rock N",), ("",)], "value string")
    assert {(r["name"], r.kind, r.vocals, r.missing) for r in I.noise_catalog(files, notes).collect()} == {("a", "music", True, False), ("b", "noise", None, False), ("z", "music", False, True)}
    assert X.recipe_values("music", "bg_snrs") == [15, 10, 8, 5] and X.recipes(spark).count() == 8


def test_shared_folder_has_a_scheme(spark):
    assert storage.shared_dir(spark).startswith("file:/") and storage.qualified(spark, "/x/y").startswith("file:/")
    df, path = storage.staged(spark.range(2), "t")
    assert df.count() == 2
    storage.discard(spark, path)
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(path).count()


def test_ids_from_paths(spark):
    p = spark.createDataFrame([("/a/b/spk1/utt.2.wrd",), ("one.txt",)], "p string")
    assert [r[0] for r in p.select(I.path_id(F.col("p"), 2)).collect()] == ["spk1_utt.2", "one"]
    files = spark.createDataFrame([("/x/S1/u1.wrd", "0 16000 HELLO\n16000 32000 World now")], "path string, content string")
    assert [(r.utt_id, r.label, r.end_us) for r in I.word_tiers(files, 16_000).orderBy("pos").collect()] == [("S1_u1", "hello", 1_000_000), ("S1_u1", "world now", 2_000_000)]
    assert [tuple(r) for r in I.layout_probe(files, [("S1", 1), ("S2", 1), ("S3", 0)]).orderBy("pattern").collect()] == [("S1", 1, 1, True), ("S2", 0, 1, False), ("S3", 0, 0, True)]


def test_samples_go_by_name(spark):
    from cadenza.operators import scoring as S

    t = spark.createDataFrame([("c", f"u{i}", k) for i in (3, 1, 2) for k in range(2)] + [("d", "z", 0)], "cell string, utt_id string, pos int")
    assert {(r.cell, r.utt_id) for r in S.first_items(t, ["cell"], 2).collect()} == {("c", "u1"), ("c", "u2"), ("d", "z")} and S.first_items(t, ["cell"], 2).count() == 5
    e = spark.createDataFrame([(1500, -1500, "silence", "vowel"), (10, 10, "vowel", "stop")], "abs_us long, signed_us long, left_class string, right_class string")
    assert [(r.abs_ms, r.signed_ms, r.silence_adjacent) for r in S.error_view(e).collect()] == [(1.5, -1.5, True), (0.01, 0.01, False)]


def test_coverage_of_splits(spark):
    t = lambda rows: spark.createDataFrame(rows, "m string, s string")
    assert tuple(Q.coverage_summary(t([("a", "x"), ("b", "x"), ("b", "y"), ("b", "y")]), "m", "s").first()) == (2, 2, False)
    assert tuple(Q.coverage_summary(t([("a", "x"), ("a", "y")]), "m", "s").first()) == (2, 1, True)
    assert {tuple(r) for r in Q.coverage_gaps(t([("a", "x"), ("b", "x"), ("b", "y")]), "m", "s").collect()} == {("a", "y")}
