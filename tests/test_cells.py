"""Cells on disk, written where hypotheses are made and scored again from their labels."""

from pyspark.sql import functions as F

from cadenza.operators import scoring as S
from cadenza.plans import cells as C
from cadenza.plans import fixtures as fx
from cadenza.sources import ingest as I

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(x, y):
    return sorted(map(str, x.collect())) == sorted(map(str, y.select(*x.columns).collect()))


def test_saved_cells_hold_all_hypotheses_compressed(spark):
    path = C._saved(spark, SMALL)
    read = I.read_cells(spark, path).where("_corrupt is null")
    rows = read.select("utt_id", F.col("tool").alias("system"), F.col("cell_condition").alias("cond"), "corpus", F.posexplode("words").alias("pos", "x")).select("*", "x.*").drop("x")
    assert same(rows, fx.hyp(spark, SMALL))
    assert I.listing(spark, path).where(~F.col("path").rlike("/[._][^/]*$") & ~F.endswith("path", F.lit(".gz"))).count() == 0
    assert I.list_cells(spark, path).count() == 12


def test_rescoring_shuffles_no_words(spark, monkeypatch):
    made = plan(C.rescore(spark, SMALL))
    assert "Generate" not in made and "Window" not in made and "collect_list(struct(" not in made
    held, real = [], fx.over_pairs
    monkeypatch.setattr(fx, "over_pairs", lambda *a: held.append(real(*a)) or held[-1])
    C._saved(spark, SMALL)
    assert plan(held[0]).count("Exchange") == plan(fx._turns(spark, SMALL)).count("Exchange")


def test_labels_are_counted_as_tiers_are(spark):
    gold, hyp = fx.gold(spark, SMALL), fx.hyp(spark, SMALL)
    packed = fx.hypotheses(spark, SMALL).select(*S.PAIR, F.col("words.label").alias("hyp"))
    assert same(S.counters(S.align(gold, hyp)), S.counted_labels(fx.gold_labels(spark, SMALL), packed))
    g = spark.createDataFrame([("u", "s", "c", ["a", None, "b"]), ("v", "s", "c", ["a"]), (None, "s", "c", ["a"])], "utt_id string, speaker_id string, corpus string, gold array<string>")
    h = spark.createDataFrame([("u", "x", "y", [None, "b", "c"]), ("u", "x", "z", []), ("v", "x", "y", None), ("w", "x", "y", ["a"]), (None, "x", "y", ["a"])], "utt_id string, system string, cond string, hyp array<string>")
    long = lambda t, c, keep: t.select(*keep, F.posexplode(c).alias("pos", "label"), F.lit(0).cast("bigint").alias("start_us"), F.lit(1).cast("bigint").alias("end_us"), F.lit(0.5).alias("conf"))
    assert same(S.counters(S.align(long(g, "gold", ["utt_id", "speaker_id", "corpus"]).drop("conf"), long(h, "hyp", S.PAIR))), S.counted_labels(g, h))
