"""Sweeps, tracks, readers by format, levels in turn."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.operators import align as L
from cadenza.operators import mixplan as X
from cadenza.operators import reports as R
from cadenza.operators import score as E
from cadenza.operators import scoring as S
from cadenza.operators import sweep as W
from cadenza.plans import fixtures as fx
from cadenza.sources import ingest as I
from cadenza.sources import readers


def test_sweep_status(spark, tmp_path):
    made = []

    def cell(n, bad=None):
        def plan():
            made.append(n)
            if bad == "plan":
                raise KeyError("no config")
            df = spark.range(n)
            return df.withColumn("id", F.raise_error(F.lit("boom")).cast("bigint")) if bad else df

        return plan

    cells = [(("a",), cell(5)), (("b",), cell(0)), (("c",), cell(3, "run")), (("d",), cell(1, "plan")), (("e",), cell(2))]
    got = {r.cell: r for r in W.run_sweep(spark, cells, ["cell"], lambda df, name: df.write.parquet(str(tmp_path / name[0]))).collect()}
    assert {k: (r.status, r.records) for k, r in got.items()} == {"a": ("OK", 5), "b": ("EMPTY", 0), "c": ("FAIL", 0), "d": ("CONFIG_FAIL", 0), "e": ("OK", 2)}
    assert made == [5, 0, 3, 1, 2] and got["a"].seconds > 0 and got["d"].seconds == 0 and "no config" in got["d"].error and got["a"].error is None


def test_tracks_by_recipe(spark):
    recipes = [
        ("/x/aligners/one/config.yaml", "name: one\n"), ("/x/timestamp_asrs/two/config.yaml", "kind: asr\n"), ("/x/aligners/three/exps/fast/config.yaml", "a: 1\nname: \"three_fast\"\n"), ("/x/aligners/four/v2/config.yaml", "name: four2 # old\n"),
        ("/x/timestamp_asrs/one/config.yaml", "name: one\n"), ("/x/aligners/five/en/c/dev/config.yaml", "name: cell\n"), ("/elsewhere/config.yaml", "name: none\n"),
    ]
    r = spark.createDataFrame(recipes, "path string, content string")
    assert {t.tool: t.kind for t in W.declared_tools(r).collect()} == {"one": "aligners", "two": "timestamp_asrs", "three_fast": "aligners", "four2": "aligners"}
    files = spark.createDataFrame([(p,) for p, _ in recipes] + [("/x/aligners/two/log/a.log",), ("/x/timestamp_asrs/six/en/x",)], "path string")
    tools = spark.createDataFrame([(t,) for t in ("one", "two", "two", "six", "seven", "cell")], "system string")
    got = {t.system: (t.kind, t.origin) for t in W.tracks(tools, files, r).collect()}
    assert got == {"one": ("aligners", "recipe"), "two": ("timestamp_asrs", "recipe"), "six": ("timestamp_asrs", "folder"), "seven": ("aligners", "default"), "cell": ("aligners", "default")}


def test_readers_equal_functions(spark, tmp_path):
    (tmp_path / "b.phn").write_text("0 2000 h#\r\n2000 4000 sh\nbad line\n 4000 16001 iy two words\n1.5 3 x\n\t1 2 tab\n")
    (tmp_path / "a.phn").write_text("")
    (tmp_path / "c.words").write_text("signal s\n#\n 0.5 121 SIL\n x 121 lost\n 1.0 121 so; s ow; s ow; UH\n 1.5 121 ; q\n 2.0 122 it; ih t; ih; PRP\n\n3 121 <VOCNOISE>; U; U; null\n4\n")
    (tmp_path / "d.words").write_text("no header\n1 2 x\n")
    names = readers.register(spark)
    assert names == ["cadenza_sample_tiers", "cadenza_cumulative_tiers"]

    def read(df, columns):
        return sorted(map(repr, df.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), *columns).collect()))

    columns = ["label", "start_us", "end_us", "pos"]
    whole = lambda suffix: I.read_whole(spark, str(tmp_path)).where(F.endswith("path", F.lit(suffix)))
    made = spark.read.format(names[0]).option("rate", 16_000).option("groupBytes", 1).load(str(tmp_path))
    assert made.rdd.getNumPartitions() == 2 and read(made, columns) == read(I.sample_tiers(whole(".phn"), 16_000), columns) and made.count() == 3
    words = spark.read.format(names[1]).load(str(tmp_path))
    assert read(words, [*columns, "fields"]) == read(I.cumulative_tiers(whole(".words")), [*columns, "fields"]) and words.count() == 6
    (tmp_path / "none").mkdir()
    assert spark.read.format(names[0]).load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="(?i)find|unknown|source"):
        spark.read.format("cadenza_nothing").load(str(tmp_path)).count()


def test_levels_take_turns(spark):
    draws = spark.createDataFrame([(f"i{k}", n, "foreground" if k % 3 else "background") for k in range(50) for n in range(k % 4)], "item_id string, n int, kind string")
    got = X.levels_in_turn(draws, {"foreground": [20, 15, 10, 5], "background": [15, 10, 5]}, fx.hash32)
    counts = {(r.kind, r.snr_db): r["count"] for r in got.groupBy("kind", "snr_db").count().collect()}
    for kind, levels in (("foreground", 4), ("background", 3)):
        held = [n for (k, _), n in counts.items() if k == kind]
        assert len(held) == levels and max(held) - min(held) <= 1
    assert got.count() == draws.count() and got.columns == [*draws.columns, "snr_db"]


def test_concise_hides_more(spark):
    t = spark.createDataFrame([("own",), ("own_x",), ("mine2",), ("mine3",)], "system string")
    names = lambda **k: {r.system for r in R.published(t, ("own",), ("own_x",), detailed_only=("mine2", "own_x"), **k).collect()}
    assert names() == {"own_x", "mine2", "mine3"} and names(concise=True) == {"mine3"}


def test_common_steps(spark):
    rng = random.Random(3)
    rows = [(f"u{u}", s, "c", p, rng.choice("ab"), p * 10, p * 10 + 10, 0.5) for u in range(9) for s in "xyz" for p in range(rng.randrange(1, 9)) if (u, s) != (3, "z")]
    gold = spark.createDataFrame([(f"u{u}", "s", "k", p, rng.choice("ab"), p * 10, p * 10 + 10) for u in range(9) for p in range(6)], "utt_id string, speaker_id string, corpus string, pos int, label string, start_us long, end_us long")
    a = S.align(gold, spark.createDataFrame(rows, "utt_id string, system string, cond string, pos int, label string, start_us long, end_us long, conf double"))
    e = S.boundary_errors(a, lambda x: x)
    want = e.join(S.common_matched(e, ["utt_id"]), ["utt_id", "gold_idx"], "left_semi").groupBy("utt_id", "system").count()
    got = S.boundary_errors(S.common_steps(a, ["utt_id"]), lambda x: x, F.col("common")).groupBy("utt_id", "system").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5


def test_labels_are_numbered_alike():
    one = pa.array([["a", None], None, [], ["b", "a"]], pa.list_(pa.string()))
    two = pa.array([[{"label": "b", "x": 1}], [{"label": None, "x": 1}]], pa.list_(pa.struct([("label", pa.string()), ("x", pa.int32())])))
    (a, n), (b, m) = L.label_codes(one.slice(0, 4), two)
    assert n.tolist() == [2, 0, 0, 2] and m.tolist() == [1, 1] and a[0] == a[3] and a[2] == b[0] and a[1] == b[1] and len({*a.tolist()}) == 3
    (c, k), _ = L.label_codes(one.slice(3), two)
    assert k.tolist() == [2] and len(c) == 2


def test_forced_source(spark):
    tier = "utt_id string, speaker_id string, corpus string, pos int, label string, start_us long, end_us long, source string"
    gold = spark.createDataFrame([("u", "s", "k", i, x, i * 10, i * 10 + 10, "timit61") for i, x in enumerate(["t", "aa", "q", "??", "s"])], tier)
    hyp = spark.createDataFrame([("u", "s", "k", i, x, i * 10 + 2, i * 10 + 12, "timit61", "y", "c", None) for i, x in enumerate(["T", "AA1", "zz9", "S"])], tier + ", system string, cond string, conf double")
    own, forced = (E.analysis_view(gold, hyp, s).collect() for s in (None, {"hyp": "arpabet"}))
    assert len([r for r in forced if r.left_class == "vowel" or r.right_class == "vowel"]) > len([r for r in own if r.left_class == "vowel" or r.right_class == "vowel"])
    assert {r.gold_idx for r in forced} == {0, 1, 2, 3} and all(r.signed_ms in (0.002, -0.008) for r in forced)
    with pytest.raises(ValueError, match="unknown label source"):
        E.analysis_view(gold, hyp, {"hyp": "nothing"})
