"""Known answers and brute-force comparisons for the interval operators."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.functions import phones
from cadenza.operators import align as A
from cadenza.operators import labels as L
from cadenza.operators import metrics as M
from cadenza.operators import mixplan as X
from cadenza.operators import pathscore as P
from cadenza.operators import scoring as S
from cadenza.operators import tiers as T
from cadenza.operators import waveform as W
from cadenza.plans import fixtures as fx
from cadenza.sources import ingest as I


def plain_alignment(g, h):
    score = {(i, 0): -i for i in range(len(g) + 1)} | {(0, j): -j for j in range(len(h) + 1)}
    for i, j in itertools.product(range(1, len(g) + 1), range(1, len(h) + 1)):
        score[i, j] = max(score[i - 1, j - 1] + (2 if g[i - 1] == h[j - 1] else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
    i, j, steps = len(g), len(h), []
    while i or j:
        if i and j and score[i, j] == score[i - 1, j - 1] + (2 if g[i - 1] == h[j - 1] else -1):
            i, j = i - 1, j - 1
            steps.append((i, j))
        elif i and score[i, j] == score[i - 1, j] - 1:
            i -= 1
            steps.append((i, -1))
        else:
            j -= 1
            steps.append((-1, j))
    return steps[::-1]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.text("ab", max_size=6), st.text("ab", max_size=6)), min_size=1, max_size=12))
def test_alignment_in_padded_batches(pairs):
    got = A.align_label_batch([list(g) for g, _ in pairs], [list(h) for _, h in pairs])
    assert [list(zip(g.tolist(), h.tolist(), strict=True)) for g, h in got] == [plain_alignment(g, h) for g, h in pairs]


def test_alignment_in_small_batches(monkeypatch):
    monkeypatch.setattr(A, "CELLS", 50)
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randrange(20))), "".join(rng.choice("abc") for _ in range(rng.randrange(20)))) for _ in range(60)]
    got = A.align_label_batch([list(g) for g, _ in pairs], [list(h) for _, h in pairs])
    assert [list(zip(g.tolist(), h.tolist(), strict=True)) for g, h in got] == [plain_alignment(g, h) for g, h in pairs]


def test_time_alignment_in_batches_is_that_of_each_pair():
    rng = random.Random(4)
    side = lambda: [{"label": rng.choice("ab"), "cls": rng.choice("xy"), "start_us": rng.randrange(10**6), "end_us": rng.randrange(10**6)} for _ in range(rng.randrange(9))]
    gold, hyp = [side() for _ in range(50)], [side() for _ in range(50)]
    one = [A.align_time_batch([g], [h])[0] for g, h in zip(gold, hyp, strict=True)]
    assert [(x.tolist(), y.tolist()) for x, y in A.align_time_batch(gold, hyp)] == [(x.tolist(), y.tolist()) for x, y in one]


def test_time_alignment_is_cheapest():
    rng = random.Random(2)
    for _ in range(40):
        side = lambda: [{"label": rng.choice("ab"), "cls": rng.choice("xy"), "start_us": rng.randrange(10**6), "end_us": rng.randrange(10**6)} for _ in range(rng.randrange(5))]  # noqa: E731, B023
        g, h = side(), side()

        def cost(i, j, g=g, h=h):
            if i == len(g) or j == len(h):
                return len(g) - i + len(h) - j
            a, b = g[i], h[j]
            pair = (0 if a["label"] == b["label"] else 0.5 if a["cls"] == b["cls"] else 2) + 2 * (abs(a["start_us"] - b["start_us"]) + abs(a["end_us"] - b["end_us"])) / 1e6
            return min(pair + cost(i + 1, j + 1), 1 + cost(i + 1, j), 1 + cost(i, j + 1))

        (x, y), total = A.align_time_batch([g], [h])[0], 0
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            if i < 0 or j < 0:
                total += 1
            else:
                a, b = g[i], h[j]
                total += (0 if a["label"] == b["label"] else 0.5 if a["cls"] == b["cls"] else 2) + 2 * (abs(a["start_us"] - b["start_us"]) + abs(a["end_us"] - b["end_us"])) / 1e6
        assert total == pytest.approx(cost(0, 0))


def tier(spark, rows, key="u"):
    return spark.createDataFrame([(key, i, label, a, b) for i, (label, a, b) in enumerate(rows)], "utt_id string, pos int, label string, start_us long, end_us long")


def hypothesis(spark, rows, system="s", conf=None):
    h = tier(spark, rows).withColumns({"system": F.lit(system), "cond": F.lit("c")})
    return h.withColumn("conf", F.lit(conf).cast("double"))


def gold_of(t):
    return t.withColumns({"speaker_id": F.lit("p"), "corpus": F.lit("k")})


def test_known_pool(spark):
    gold = gold_of(tier(spark, [("sil", 0, 100_000), ("s", 100_000, 200_000), ("aa", 200_000, 350_000), ("sil", 350_000, 500_000)]))
    hyp = hypothesis(spark, [("sil", 0, 120_000), ("s", 120_000, 210_000), ("aa", 210_000, 360_000), ("sil", 360_000, 500_000)])
    e = S.boundary_errors(S.align(gold, hyp), phones.manner)
    r = M.summary(e, ["system"], (10, 20)).first()
    assert (r["n_boundaries"], r["mae_ms"], r["median_ms"], r["signed_ms"], r["ta_10ms"], r["ta_20ms"], r["onset_mae_ms"], r["offset_mae_ms"]) == (8, 10, 10, 10, 0.75, 1, 10, 10)
    types = {(x["left_class"], x["right_class"]): (x["n"], x["mae_ms"]) for x in M.per_type(e, ["system"]).collect()}
    assert types["silence", "silence"] == (2, 0) and types["silence", "fricative"][1] == 20 and types["fricative", "vowel"][1] == 10
    assert e.where("left_class <> 'silence' and right_class <> 'silence'").count() == 2


def test_class_matching_leaves_recall(spark):
    gold = gold_of(tier(spark, [("s", 0, 10), ("aa", 10, 20), ("t", 20, 30)]))
    a = S.align(gold, hypothesis(spark, [("z", 0, 10), ("m", 10, 20), ("t", 20, 30)]))
    same = S.matched(lambda g, h: phones.manner8(g) == phones.manner8(h))
    assert sorted({r["gold_idx"] for r in S.boundary_errors(a, phones.manner, same).collect()}) == [0, 2]
    assert [r["gold_idx"] for r in S.boundary_errors(a, phones.manner).collect()] == [2, 2]
    c = S.counters(a).first()
    assert (c["n_matched"], c["n_gold"], c["n_sub"]) == (1, 3, 2)


def test_greedy_is_not_maximum():
    at = lambda x: (np.array(x, np.int64), np.array([len(x)]))
    assert S.hits_of(*at([0, 15_000]), *at([14_000, 34_000]), 20_000).tolist() == [1]


def test_nearest_of():
    rng = np.random.default_rng(2)
    g, h = ([np.unique(rng.integers(-50, 300, n)) for n in sizes] for sizes in ([5, 0, 9, 1, 30], [4, 3, 0, 7, 20]))
    sizes = lambda x: np.array([len(y) for y in x])
    got = S.nearest_of(np.concatenate(g), sizes(g), np.concatenate(h), sizes(h), 15)
    want = [min(((abs(a - t), i) for i, a in enumerate(x) if abs(a - t) <= 15), default=(0, -1))[1] for x, y in zip(g, h, strict=True) for t in y]
    assert got.tolist() == want and S.hits_of(np.concatenate(g), sizes(g), np.concatenate(h), sizes(h), 15).tolist() == [slow_hits(x, y, 15) for x, y in zip(g, h, strict=True)]


def slow_hits(g, h, tol):
    used_g, used_h = set(), set()
    for _, i, j in sorted((abs(a - b), i, j) for i, a in enumerate(g) for j, b in enumerate(h) if abs(a - b) <= tol):
        if i not in used_g and j not in used_h:
            used_g.add(i)
            used_h.add(j)
    return len(used_g)


def test_hits_both_ways(spark):
    rng, gold, hyp, want = random.Random(3), None, None, {}
    for k in range(12):
        side = lambda: sorted(rng.randrange(0, 300_000, 5_000) for _ in range(rng.randrange(1, 15)))
        a, b = side(), side()
        rows = lambda t: [("x", s, s + 1) for s in t]
        g, h = gold_of(tier(spark, rows(a), f"u{k}")), tier(spark, rows(b), f"u{k}").withColumns({"system": F.lit("s"), "cond": F.lit("c"), "conf": F.lit(0.5)})
        gold, hyp = (g, h) if gold is None else (gold.unionAll(g), hyp.unionAll(h))
        want[f"u{k}"] = slow_hits(sorted(set(a[1:])), sorted(set(b[1:])), 20_000)
    assert {r["utt_id"]: r["n_hits"] for r in S.segmentation(gold, hyp).collect()} == want
    assert {r["utt_id"]: r["n_hits"] for r in S.segmentation_packed(S.align(gold, hyp)).collect()} == want


def test_common_matched(spark):
    rows = [("u", s, i) for s, idx in (("a", (0, 1, 2, 3)), ("b", (0, 1, 3))) for i in idx] + [("v", "a", 7)]
    e = spark.createDataFrame(rows, "utt_id string, system string, gold_idx int")
    assert {(r["utt_id"], r["gold_idx"]) for r in S.common_matched(e, ["utt_id"]).collect()} == {("u", 0), ("u", 1), ("u", 3), ("v", 7)}


def pool(spark, rows):
    return spark.createDataFrame([("s", a * 1000, c) for a, c in rows], "system string, abs_us long, conf double")


def test_calibration(spark):
    good = pool(spark, [(5, 0.9), (10, 0.8), (40, 0.2), (90, 0.1)])
    assert M.spearman(good, ["system"]).first()["spearman"] == 1 and M.auroc(good, ["system"]).first()["auroc"] == 1
    bad = pool(spark, [(5, 0.1), (10, 0.2), (40, 0.8), (90, 0.9)])
    assert M.auroc(bad, ["system"]).first()["auroc"] == 0
    assert M.ece(pool(spark, [(5, 0.1), (5, 0.1)]), ["system"]).first()["ece"] == pytest.approx(0.9)
    odd = pool(spark, [(5, 1.5), (6, None), (7, float("nan"))])
    assert M.ece(odd, ["system"]).first()["ece"] is None and M.ece(odd, ["system"]).first()["n_conf"] == 1
    assert M.spearman(pool(spark, [(5, 0.5), (6, 0.5), (7, 0.5)]), ["system"]).first()["spearman"] is None
    assert M.auroc(pool(spark, [(5, 0.5)]), ["system"]).first()["auroc"] is None


def test_tail_and_decomposition(spark):
    e = pool(spark, [(10, 0.0), (20, 0.0), (30, 0.0), (200, 0.0)])
    t = M.tail(e, ["system"]).first()
    assert (t["mae"], t["median"], t["pct_gt100"], t["max"]) == (65, 25, 25, 200)
    parts = {r["bucket"]: r["contrib_ms"] for r in M.decomposition(e, ["system"]).collect()}
    assert sum(parts.values()) == pytest.approx(65) and parts["le10"] == 2.5 and parts["gt100"] == 50


def test_detection_edge_cases(spark):
    c = spark.createDataFrame([("a", 4, 4, 4), ("b", 4, 0, 0), ("c", 0, 0, 0), ("d", 4, 8, 0)], "k string, n_gold_bnd long, n_hyp_bnd long, n_hits long")
    r = {x["k"]: x for x in M.detection(c, ["k"]).collect()}
    assert (r["a"]["bnd_f1"], r["a"]["bnd_os"], r["a"]["r_value"]) == (1, 0, 1)
    assert r["b"]["bnd_f1"] == 0 and r["b"]["bnd_precision"] is None and r["c"]["bnd_f1"] is None and r["d"]["bnd_os"] == 1


def test_registry_takes_a_key_once():
    reg = M.pool_metrics()
    with pytest.raises(ValueError):
        reg.register(next(iter(reg)))
    assert [m.key for m in reg][:3] == ["mae_ms", "median_ms", "signed_ms"]


def test_inventory_is_total(spark):
    symbols = {s for g in phones.MANNER.values() for s in g.split()}
    assert len(symbols) == 39 == len({s for g in phones.MANNER8.values() for s in g.split()})
    assert {r["canonical"] for r in phones.label_map(spark).collect()} - {None} == symbols
    t = spark.createDataFrame([("u", i, x, s) for i, (x, s) in enumerate([("AA1", "arpabet"), ("IX", "timit61"), ("q", "timit61"), ("zzz", "timit61"), ("h#", "timit61"), ("ao", "timit61")])], "utt_id string, pos int, label string, source string")
    c = L.canonicalize(t, phones.label_map(spark))
    assert [(r["canonical"], r["outcome"]) for r in c.orderBy("pos").collect()] == [("aa", "mapped"), ("ih", "mapped"), (None, "delete"), (None, "unmapped"), ("sil", "mapped"), ("aa", "mapped")]
    assert [(r["pos"], r["label"]) for r in L.prepare_tier(c, ["utt_id"]).orderBy("pos").collect()] == [(0, "aa"), (1, "ih"), (2, "UNMAPPED:3"), (3, "sil"), (4, "aa")]
    with pytest.raises(ValueError):
        L.check_source("nothing")


def test_merge_closures(spark):
    t = tier(spark, [("h#", 0, 1), ("tcl", 1, 2), ("t", 2, 3), ("aa", 3, 4), ("kcl", 4, 5), ("s", 5, 6)])
    got = [(r["pos"], r["label"], r["start_us"], r["end_us"]) for r in T.merge_closures(t, ["utt_id"]).orderBy("pos").collect()]
    assert got == [(0, "h#", 0, 1), (1, "t", 1, 3), (2, "aa", 3, 4), (3, "k", 4, 5), (4, "s", 5, 6)]


def test_segments(spark):
    s = 1_000_000
    t = tier(spark, [("w", 0, s), ("SIL", s, 2 * s), ("w", 2 * s, 3 * s), ("w", 3 * s, 4 * s), ("SIL", 4 * s, 9 * s), ("w", 9 * s, 10 * s), ("BREAK", 10 * s, 11 * s), ("SIL", 11 * s, 12 * s), ("w", 12 * s, 13 * s), ("w", 13 * s, 14 * s)])
    sil, hard = F.col("label") == "SIL", F.col("label") == "BREAK"
    got = [(r["segment"], r["start_us"] // 1000, r["end_us"] // 1000, r["n_words"]) for r in T.segment_pauses(t, ["utt_id"], sil, hard, 3 * s, 200_000, 2).orderBy("segment").collect()]
    assert got == [(0, 0, 4200, 3), (1, 11800, 14000, 2)]
    native = [(r["start_us"], r["n"]) for r in T.segment_native(t, ["utt_id"], hard, s, 3).orderBy("segment").collect()]
    assert native == [(0, 6), (11 * s, 3)]


def test_tier_edges(spark):
    t = tier(spark, [("A.,", -5, 10), (" ", 10, 10), ("b", 10, 99)])
    assert [r["label"] for r in T.clean_labels(t, ["utt_id"]).orderBy("pos").collect()] == ["a", "b"]
    assert [(r["start_us"], r["end_us"]) for r in T.clamp(t, F.lit(50)).orderBy("pos").collect()] == [(0, 10), (10, 10), (10, 50)]
    assert T.drop_degenerate(t, ["utt_id"]).count() == 2
    assert {(r["pos"], r["rule"]) for r in T.violations(t, ["utt_id"], F.lit(50), 1).collect()} == {(0, "negative_start"), (1, "not_positive"), (2, "past_end")}
    kept, dropped = T.drop_out_of_range(t, ["utt_id"], F.lit(50), 10)
    assert kept.count() == 2 and dropped.first()["n_dropped"] == 1
    odd = tier(spark, [("early", -11, 5), ("edge", -10, 60), ("late", 61, 5), ("fine", 1, 2)])
    assert [r["label"] for r in T.drop_out_of_range(odd, ["utt_id"], F.lit(50), 10)[0].orderBy("pos").collect()] == ["edge", "fine"]
    assert T.drop_out_of_range(odd, ["utt_id"], F.lit(None).cast("long"), 10)[1].first()["n_dropped"] == 0
    words = spark.createDataFrame([("<EXT-a_b-c>",), ("<EXT-x=y>",), ("plain",), ("<EXT->",)], "label string")
    assert [r[0] for r in words.select(T.recover_hidden_words(F.col("label"))).collect()] == ["a b c", None, None, None]
    assert T.overlapping(t, tier(spark, [("x", 20, 30)]), ["utt_id"]).count() == 1


def test_path_switches(spark):
    rows = [(0, "sil", "sil", 0, 0), (1, "-", "sp", None, 160), (2, "dh", "dh", 200, 240), (3, "ah", "ah", 280, 300), (4, "sil", "sil", 350, 370)]
    steps = spark.createDataFrame([("p", *r) for r in rows], "k string, step int, ref_label string, test_label string, ref_us long, test_us long")
    n = lambda **k: P.path_boundaries(steps, ["k"], **k).count()
    assert (n(), n(gaps=True), n(edges=True), n(edges=True, gaps=True)) == (2, 3, 3, 4)
    e = P.path_errors(P.path_boundaries(steps, ["k"])).orderBy("step").collect()
    assert [(r["signed_us"], r["edge"], r["prev_ref"]) for r in e] == [(20, "boundary", "dh"), (20, "boundary", "ah")]


def test_readers(spark, tmp_path):
    (tmp_path / "a.phn").write_text("0 2000 h#\n2000 4000 sh\nbad line\n4000 16000 iy two words\n")
    got = I.sample_tiers(I.read_whole(spark, str(tmp_path)), 16_000).orderBy("pos").collect()
    assert [(r["label"], r["start_us"], r["end_us"]) for r in got] == [("h#", 0, 125_000), ("sh", 125_000, 250_000), ("iy two words", 250_000, 1_000_000)]
    files = spark.createDataFrame([("f", "signal s\n#\n 0.5 121 SIL\n x 121 lost\n 1.0 121 so; s ow; s ow; UH\n 1.5 121 ; q\n 2.0 122 it; ih t; ih; PRP\n 3 121 <VOCNOISE>; U; U; null")], "path string, content string")
    t = I.cumulative_tiers(files)
    assert [(r["label"], r["start_us"], r["end_us"]) for r in t.orderBy("pos").collect()][:4] == [("SIL", 0, 500_000), ("so", 500_000, 1_000_000), ("121", 1_000_000, 1_500_000), ("it", 1_500_000, 2_000_000)]
    assert [(r["word"], r["is_canonical"]) for r in I.word_pronunciations(t).orderBy("pos").collect()] == [("so", True), ("it", False)]
    one = spark.createDataFrame([("u1 wav-reverberate --impulse-response=\"sox /r/x.wav -\" --additive-signals='/n/a.wav,wav-x \"/n/b c.wav\" - |' --snrs='5,10.5' --start-times='0,2'",), ("u2 cat",)], "value string")
    c = {r["key"]: r for r in I.mix_commands(one).collect()}
    assert c["u1"]["noises"] == ["/n/a.wav", "/n/b c.wav"] and c["u1"]["snrs"] == [5, 10.5] and c["u1"]["rir"] == "/r/x.wav" and c["u2"]["noises"] == [] and c["u2"]["rir"] is None
    with pytest.raises(ValueError):
        I.assert_gold_allowed(spark.createDataFrame([("/x/LibriTTS_R/a.txt",)], "path string"))
    found = {x: spark.range(1).select(I.machine_aligned(F.lit(x), ("own_list",))).first()[0] for x in ("/a/LibriTTS_R/b", "/a/librispeech-alignments", "/x/cmu_arctic/1", "/x/own-list/1", "/x/timit/train")}
    assert [*found.values()] == ["libritts", "librispeech-alignments", "cmu-arctic", "own_list", None]
    assert I.layout_probe(spark.createDataFrame([("/a/b.wav",)], "path string"), [(r"\.wav$", 1), (r"\.txt$", 1)]).where("ok").count() == 1
    cells = spark.createDataFrame([("/root/aligners/t/en/c/dev/origin/f.json",)], "path string").select(*I.cell_key(F.col("path"))).first()
    assert tuple(cells) == ("aligners", "t", "en", "c", "dev", "origin")


def test_snapshots(spark, tmp_path):
    path, t = str(tmp_path / "s"), spark.createDataFrame([("a", 1)], "k string, v int")
    I.publish(t, path, "202607")
    I.publish(t.withColumn("v", F.lit(2)), path, "202608")
    assert [r["v"] for r in I.latest(spark, path).collect()] == [2]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "x.json").write_text('{"item_id": "i", "words": [{"label": "a", "start_us": 1, "end_us": 2}]}\n\n{broken\n')
    rows = I.read_json(spark, str(tmp_path / "j")).collect()
    assert len(rows) == 2 and {r["item_id"] for r in rows} == {"i", None}


def test_mixing(spark):
    rng = np.random.default_rng(0)
    rows = [(str(s), rng.normal(size=64).tolist(), rng.normal(size=64).tolist(), float(s)) for s in (20, 15, 10)]
    got = W.mix(spark.createDataFrame(rows, "item_id string, speech array<double>, noise array<double>, snr_db double"), 16_000).collect()
    assert all(abs(r["snr_db"] - float(r["item_id"])) < 0.5 and len(r["samples"]) == 64 for r in got)
    with pytest.raises(Exception, match="samples"):
        W.mix(spark.createDataFrame([("x", [1.0, 2.0], [1.0], 5.0)], "item_id string, speech array<double>, noise array<double>, snr_db double"), 16_000).collect()
    pool = spark.range(20).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"))
    a, b = (X.split_pool(pool, "file", fx.hash32, 3).orderBy("file").collect() for _ in range(2))
    assert a == b and sum(r["half"] == "train" for r in a) == 10 and {r["idx"] for r in a if r["half"] == "eval"} == set(range(10))


def test_partitions_dont_matter(spark):
    from cadenza.plans import alignment

    kept, out = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(str, alignment.leaderboard(spark, "/root/testdata/sf0.001").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert out[0] == out[1]


def test_range_joins_over_intervals_of_any_length(spark):
    import random

    draw = random.Random(5)
    rows = lambda n: [(draw.choice("ab"), k, f"x{k}", s, s + int(10 ** draw.uniform(0, 17 if k < 2 else 9))) for k in range(n) for s in [draw.randrange(10**9)]]  # noqa: E731  up to thousands of years
    left, right = rows(60), rows(60) + [("a", 99, "empty", 5, 5), ("c", 0, "alone", 0, 9)]
    cols = "utt_id string, pos int, label string, start_us long, end_us long"
    t, u = spark.createDataFrame(left, cols), spark.createDataFrame(right, cols)
    spans = t.select("utt_id", F.col("pos").alias("k"), F.col("start_us").alias("s"), F.col("end_us").alias("e"))
    found = lambda contained: sorted((r.utt_id, r.k, r.pos) for r in T.meetings(spans, u, ["utt_id"], contained).collect())
    pairs = [(a, b) for a in left for b in right if a[0] == b[0]]
    met = [(a, b) for a, b in pairs if b[4] > a[3] and b[3] < a[4]]
    assert found(False) == sorted((a[0], a[1], b[1]) for a, b in met)
    assert found(True) == sorted((a[0], a[1], b[1]) for a, b in pairs if b[3] >= a[3] - 1 and b[4] <= a[4] + 1)
    assert sorted(r.pos for r in T.overlapping(t, u, ["utt_id"]).collect()) == sorted({a[1] for a, _ in met})
