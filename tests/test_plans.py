"""Noise plans, gates and systems under test: known answers, empty tables, and queries against their SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_entry import SF, TABLES

from cadenza.operators import gates as Q
from cadenza.operators import metrics as M
from cadenza.operators import mixplan as X
from cadenza.operators import systems as Y
from cadenza.operators import tiers as T
from cadenza.plans import fixtures as fx
from cadenza.plans import registry

CHECKED = ["background_draws", "point_noises", "isotropic_noises", "room_probabilities", "replicate_recordings", "gate_plausibility", "coverage_gaps", "coverage_summary", "link_degraded", "gate_known_answers", "run_system"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    made = registry.queries()[name](spark, SF)
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(made.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in made.collect()))) == sorted(map(repr, cursor.fetchall()))


def test_smoothing(spark):
    m = spark.createDataFrame([("a", 0.5), ("a", None), ("a", None), ("b", 1.0), ("b", None), ("c", None), ("z", 0.0)], "g string, probability double")
    got = sorted((r.g, None if r.probability is None else round(r.probability, 9)) for r in X.smooth_probabilities(m, ["g"], 0.5, 2.0).collect())
    # a: the two share 0.25 each, the first moves half way from 0.5 to 0.25
    assert got == [("a", round(0.5 / 0.875, 9)), ("a", round(0.5 / 0.875, 9)), ("a", round(0.75 / 0.875, 9)), ("b", 0.0), ("b", 2.0), ("c", 2.0), ("z", None)]


def test_point_noises_stay_inside(spark):
    items = spark.createDataFrame([(f"i{k}", 1_000_000 * k) for k in range(40)] + [("null", None)], "item_id string, dur_us bigint")
    pool = spark.createDataFrame([(0, "f", "foreground"), (1, "b", "background")], "idx int, file string, kind string")
    rows = X.point_noises(items, pool, fx.hash32, 2, 12, {"foreground": [9], "background": [1, 2]}).collect()
    seen = {}
    for r in rows:
        k = int(r.item_id[1:])
        seen.setdefault(k, []).append(r)
        assert 0 <= r.at_us <= 1_000_000 * k and r.at_us % 10_000 == 0
        assert (r.snr_db == 9) if r.file == "f" else (r.at_us == 0 and r.snr_db in (1, 2))
    assert {*seen} == {*range(5, 40)} and all(1 <= len(v) <= k // 5 for k, v in seen.items())
    for v in seen.values():  # turns: two of a kind in a row never have the same of two levels
        back = [r.snr_db for r in sorted(v, key=lambda r: r.n) if r.file == "b"]
        assert all(a != b for a, b in zip(back, back[1:]))
    assert X.point_noises(items.where("false"), pool, fx.hash32, 2, 12, {"foreground": [9], "background": [1]}).count() == 0


def test_background_and_isotropic(spark):
    items = spark.createDataFrame([(f"i{k}", k % 3) for k in range(30)], "item_id string, room int")
    pool = spark.createDataFrame([(0, "f"), (1, "g")], "idx int, file string")
    assert X.background_draws(items, pool, fx.hash32, 2, [0], [5]).count() == 0
    assert X.background_draws(items, pool, fx.hash32, 2, [2], [5]).groupBy("item_id").count().where("count = 2").count() == 30
    rooms = spark.createDataFrame([(0, "x"), (0, "y"), (0, "y"), (1, "z")], "room int, file string")
    got = X.isotropic_noises(items, rooms, fx.hash32, [7]).collect()
    assert len(got) == 20 and {r.file for r in got} == {"x", "y", "z"} and all(r.snr_db == 7 for r in got)


def test_replicas(spark):
    t = spark.createDataFrame([("u", 1)], "id string, x int")
    assert sorted((r.id, r.copy) for r in X.replicate(t, ["id"], 2, "r").collect()) == [("r1-u", 1), ("r2-u", 2)]
    assert sorted(r.id for r in X.replicate(t, ["id"], 1, "r", original=True).collect()) == ["r0-u", "r1-u"]
    assert X.replicate(t, ["id"], 0, "r").count() == 0
    assert X.rekey(t, ["id"], "a-", "_b").first().id == "a-u_b"


def test_plausibility(spark):
    quiet, loud = [0.001] * 400, [0.5] * 400
    waves = spark.createDataFrame([(1, quiet + loud + quiet), (2, loud * 3), (3, [0.1] * 3), (4, None)], "k int, samples array<double>")
    tier = spark.createDataFrame([(k, i, lab, i * 400_000, (i + 1) * 400_000) for k in (1, 2, 3, 4) for i, lab in enumerate(["sil", "a", "sil"])], "k int, pos int, label string, start_us bigint, end_us bigint")
    got = {r.k: r for r in Q.plausibility(waves, tier, ["k"], F.col("label") == "sil", fx.hash32, 1000, 25, 5).collect()}
    assert got[1].plausible and got[1].n_boundaries == 2 and got[1].step_db > 20
    assert got[2].plausible is False and got[2].step_db == 0
    assert got[3].plausible is None and got[4].plausible is None and got[3].n_boundaries == 0


def test_coverage_and_kinds(spark):
    t = spark.createDataFrame([("a", "s", "x"), ("b", "s", "x"), ("a", "t", "y")], "system string, split string, kind string")
    assert [(r.system, r.split) for r in Q.coverage_gaps(t, "system", "split").collect()] == [("b", "t")]
    assert Q.coverage_gaps(t.where("false"), "system", "split").count() == 0
    assert tuple(Q.coverage_summary(t, "system", "split").first()) == (2, 2, False)
    assert [tuple(r) for r in Q.one_kind(t).collect()] == [("a", 2)]
    m = spark.createDataFrame([("x", "a", 2.0), ("x", "b", 1.0), ("x", "c", None), ("y", "d", 9.0)], "kind string, system string, m double")
    assert {r.system: r.place for r in Q.rank_within(m, ["kind"], "m").collect()} == {"a": 2, "b": 1, "c": None, "d": 1}


def test_pauses(spark):
    t = spark.createDataFrame([("u", 0, 0, 100), ("u", 1, 100, 200), ("u", 2, 2000, 2100)], "utt_id string, pos int, start_us bigint, end_us bigint")
    assert [(r.before, r.after) for r in T.pauses(t, ["utt_id"], 1000).orderBy("pos").collect()] == [(True, False), (False, True), (True, True)]


def test_systems(spark):
    items = spark.createDataFrame([("a", 1_000_000, "x y"), ("b", 1_000_000, "x"), ("c", None, "p q")], "item_id string, dur_us bigint, transcript string")

    def work(item):
        if "transcript" not in item:
            return [], None
        if item["dur_us"] is None:
            raise KeyError("no audio")
        return [(w, 0, 1, 0.5) for w in item["transcript"].split()], {"n": "1"}

    got = {r.item_id: r for r in Y.run_system(items, Y.System("s", "aligners", ("A",), Y.one_by_one(work)), "A").collect()}
    assert [w.label for w in got["a"].words] == ["x", "y"] and got["a"].error is None and got["a"].rtf >= 0 and got["a"].meta == {"n": "1"}
    assert got["c"].words is None and got["c"].error.startswith("KeyError")
    deaf = Y.run_system(items, Y.System("t", "timestamp_asrs", ("B",), Y.one_by_one(work)), "B").collect()
    assert all(r.words == [] and r.error is None for r in deaf)
    with pytest.raises(ValueError):
        Y.run_system(items, Y.System("s", "aligners", ("A",), Y.one_by_one(work)), "B")
    with pytest.raises(ValueError):
        Y.System("s", "other", (), work)
    assert Y.run_system(items.where("false"), Y.System("s", "aligners", ("A",), Y.one_by_one(work)), "A").count() == 0


def test_analytics(spark):
    a = Y.Analytics()
    a.add("n", "count")(lambda df: df.groupBy().count())
    assert a.run("n", spark.range(3)).first()[0] == 3 and [*a.held] == ["n"]
    with pytest.raises(ValueError):
        a.add("n", "again")(lambda df: df)


def test_babble(spark):
    items = spark.createDataFrame([(f"i{k}",) for k in range(200)], "item_id string")
    for size in (6, 7, 40):
        talkers = spark.createDataFrame([(i, f"t{i}") for i in range(size)], "idx bigint, talker string")
        got = [r.sources.split("+") for r in X.pick_babble(items, talkers, fx.hash32, 6, size).collect()]
        assert len(got) == 200 and all(len({*g}) == 6 for g in got) and len({t for g in got for t in g}) == size
    with pytest.raises(ValueError):
        X.pick_babble(items, talkers, fx.hash32, 41, 40)


def test_weighted_pick(spark):
    items = spark.createDataFrame([(f"i{k}",) for k in range(3000)], "item_id string")
    weights = {"a": 1, "b": 0, "c": 7, "d": 1000, "e": 1, "f": 991}
    choices = spark.createDataFrame([*weights.items()], "choice string, weight bigint")
    got = {r.item_id: r.choice for r in X.weighted_pick(items, choices, fx.hash32).collect()}
    ranges, low = {}, 0
    for c, n in weights.items():
        ranges[c], low = range(low, low + n), low + n
    drawn = {r[0]: r[1] for r in items.select("item_id", fx.hash32(F.concat(F.lit("rir:"), "item_id"))).collect()}
    assert len(got) == 3000 and all(drawn[i] % low in ranges[c] for i, c in got.items())
    assert X.weighted_pick(items, choices.where("weight = 0"), fx.hash32).count() == 0


def compare(spark, monkeypatch, rows):
    hyp = spark.createDataFrame(rows, "utt_id string, system string, cond string, pos int, label string, start_us bigint, end_us bigint, conf double")
    monkeypatch.setattr(fx, "hyp", lambda *_: hyp)
    return {(r.cond, r.state): r.n for r in registry.queries()["compare_all_runs"](spark, SF).collect()}


def test_runs_are_compared_whole(spark, monkeypatch):
    row = lambda s, cond="clean", pos=0, label="x", end=9, conf=None: ("u", f"sys_{s}", cond, pos, label, 0, end, conf)
    rows = [row("a"), row("b"), row("a", pos=1), row("b", pos=1, end=8), row("a", "noise"), row("b", "noise", label=None), row("a", "noise", 1, conf=0.5), row("b", "noise", 1)]
    rows += [row("a", "noise", 2), row("b", "noise", 3), row("a", "noise", 4, None), row("b", "noise", 4, None), row("c", pos=7)]
    want = {("clean", "same"): 1, ("clean", "different"): 1, ("noise", "different"): 2, ("noise", "only_a"): 1, ("noise", "only_b"): 1, ("noise", "same"): 1}
    assert compare(spark, monkeypatch, rows) == want


@pytest.mark.parametrize("name", ["compare_all_runs", "bootstrap_whole"])
def test_whole_query_equals_sql(spark, name):
    test_query_equals_sql(spark, name)


def test_bootstrap_of_several_means(spark):
    per = spark.createDataFrame([("g", f"u{k}", 1000 * k, k % 2, 1) for k in range(30)], "g string, utt_id string, s bigint, t bigint, c bigint")
    one, both = (M.bootstrap(per, ["g"], replicates=100, more=m).first().asDict() for m in (None, {"ta": ("t", 1)}))
    assert {k: both[k] for k in one} == one and 0 < both["ta_lo"] < 0.5 < both["ta_hi"] < 1
    same = M.bootstrap(per.withColumn("t", F.col("s")), ["g"], replicates=100, more={"ta": ("t", 1000)}).first()
    assert (same.ta_lo, same.ta_hi) == (same.lo, same.hi)


def test_weights_are_poisson(spark):
    values = np.arange(65_536)
    weight = sum((values >= t).astype(int) for t in M.POISSON)
    assert abs(weight.mean() - 1) < 1e-4 and abs(weight.var() - 1) < 1e-3 and abs((weight == 0).mean() - np.exp(-1)) < 2e-5
    rng = np.random.default_rng(1)
    x = rng.gamma(2, 5000, 400).astype(int)
    got = M.bootstrap(spark.createDataFrame([("g", f"u{i}", int(v), 1) for i, v in enumerate(x)], "g string, utt_id string, s bigint, c bigint"), ["g"]).first()
    plain = np.quantile([rng.choice(x, len(x)).mean() / 1000 for _ in range(2000)], [0.025, 0.975])
    assert [got.lo, got.hi] == pytest.approx(plain, rel=0.03)


def test_foreground_covers_long_items(spark):
    items = spark.createDataFrame([("long", 10_000_000), ("short", 1), ("none", 0)], "item_id string, dur_us bigint")
    pool = spark.createDataFrame([(0, "a", 100_000), (1, "b", 300_000)], "idx int, file string, noise_us bigint")
    rows = X.foreground_draws(items, pool, fx.hash32, 2, 50_000, 100_000).orderBy("item_id", "n").collect()
    size, at = {"a": 100_000, "b": 300_000}, 0
    for r in [r for r in rows if r.item_id == "long"]:
        assert r.at_us == at < 10_000_000
        at += size[r.file] + 50_000
    assert at >= 10_000_000 and sum(r.item_id == "short" for r in rows) == 1 and not any(r.item_id == "none" for r in rows)


def test_labels_of_speech(spark):
    labels = ["SIL", "ah", "<X>", "", "AH", "lau", "{B_TRANS}", "Noise", "t-", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, label string").orderBy("i")
    rows = df.select(T.is_break(F.col("label")), T.is_nonspeech(F.col("label")), T.is_real_phone(F.col("label")), T.rename_events(F.col("label")), T.is_sil(F.col("label"))).collect()
    assert [r[0] for r in rows] == [True, False, True, False, False, False, True, True, False, None]
    assert [r[1] for r in rows] == [True, False, True, True, True, False, True, True, False, None]
    assert [r[2] for r in rows] == [False, True, False, False, False, True, False, False, True, None]
    assert [r[3] for r in rows] == ["!sil", "ah", "<X>", "", "AH", "lau", "{B_TRANS}", "[noise]", "t-", None]


def test_segments_keep_their_numbers(spark):
    s = spark.createDataFrame([("a", 0, -5, 300_000), ("a", 1, 400_000, 950_000), ("a", 2, 990_000, 2_000_000), ("b", 0, 5, 9)], "track string, segment int, start_us bigint, end_us bigint")
    got = T.clamp_segments(s, spark.createDataFrame([("a", 1_000_000)], "track string, dur_us bigint"), ["track"]).orderBy("track", "segment").collect()
    assert [tuple(r) for r in got] == [("a", 0, 0, 300_000), ("a", 1, 400_000, 950_000), ("b", 0, 5, 9)]


def test_segments_by_another_tier(spark):
    s, tier = 1_000_000, "utt_id string, pos int, label string, start_us bigint, end_us bigint"
    make = lambda rows: spark.createDataFrame([("u", i, lab, int(a * s), int(b * s)) for i, (lab, a, b) in enumerate(rows)], tier)
    phones = make([("a", 0, 0.5), ("a", 0.5, 1), ("b", 1, 2), ("SIL", 2, 4), ("c", 4, 5), ("d", 5, 30), ("SIL", 30, 32), ("e", 32, 33), ("f", 33, 34)])
    words = make([("one", 0, 1), ("two", 1, 2), ("<CUTFF-s=seem>", 4, 5), ("x", 5, 6), ("<SIL>", 30, 32), ("three", 32, 33), ("four", 33, 34)])
    sil = F.col("label") == "SIL"
    cut = lambda n, w: [(r.start_us // s, r.end_us // s, r.n_words) for r in T.segment_pauses(phones, ["utt_id"], sil, F.lit(False), s, 0, n, w, ~F.col("label").startswith("<")).orderBy("segment").collect()]
    assert cut(2, words) == [(0, 2, 2), (32, 34, 2)] and cut(3, words) == [] and len(cut(2, None)) == 3
    native = T.segment_native(words, ["utt_id"], F.col("label") == "<SIL>", s, 3, phones)
    assert [(r.start_us // s, r.end_us // s, r.n) for r in native.collect()] == [(0, 6, 5)] and T.segment_native(words, ["utt_id"], F.col("label") == "<SIL>", s, 6, phones).count() == 0
    assert sorted((r.label, r.start_us) for r in T.rebase(native.withColumn("start_us", F.lit(s)), phones, ["utt_id"]).collect()) == [("SIL", s), ("b", 0), ("c", 3 * s)]
    bad = ["unknown", "<CUTOFF-a>", "<EXCLUDE>", "Excised", "<ERROR-a=b>", " <LAUGH-a=b>", "word", "<LAUGH=a_b>", None]
    assert [r[0] for r in spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "i int, label string").orderBy("i").select(T.disqualifies(F.col("label"))).collect()] == [True] * 6 + [False] * 3
