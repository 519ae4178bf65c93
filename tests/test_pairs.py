"""Pairs that are derived packed, word tiers and pauses in them, and alignment by time over columns."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.operators import align as L
from cadenza.operators import score as E
from cadenza.operators import scoring as S
from cadenza.operators import tiers as T
from cadenza.plans import alignment as A
from cadenza.plans import fixtures as fx

SMALL = "/root/testdata/sf0.001"


def test_pairs_are_what_pairing_gives_and_shuffle_once(spark):
    made = fx.pairs(spark, SMALL)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + made._jdf.queryExecution().executedPlan().toString().count("Exchange range") == 1
    key = lambda p: sorted((r.utt_id, r.system, r.cond, r.speaker_id, r.corpus, r.gold, r.hyp) for r in p.collect())
    assert key(made) == key(S.pair(fx.gold(spark, SMALL), fx.hyp(spark, SMALL)))


def test_packed_tiers_lose_labels_and_know_pauses_as_long_ones(spark):
    rows = [("u", 0, "SIL", 0, 10), ("u", 1, "A", 10, 20), ("u", 2, "sp", 20, 30), ("u", 3, "b", 30, 40), ("u", 4, "c", 40, 50)]
    long = spark.createDataFrame(rows, "utt_id string, pos int, label string, start_us long, end_us long")
    packed = S.pack(long, ["utt_id"]).select("utt_id", F.col("tier").alias("gold"), F.col("tier").alias("hyp"))
    got = T.drop_packed(packed, ("sil", "sp"), F.lower).select("utt_id", F.inline(T.pauses_packed("gold", 1))).select("pos", "label", "before", "after").collect()
    kept = T.drop_labels(long.withColumn("label", F.lower("label")), ["utt_id"], ("sil", "sp"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, T.pauses(kept, ["utt_id"], 1).select("pos", "label", "before", "after").collect())) == [(0, "a", True, True), (1, "b", True, False), (2, "c", False, True)]
    assert T.drop_packed(packed, ("sil", "sp", "a", "b", "c")).count() == 0


def test_time_alignment_reads_columns():
    element = pa.struct([("pos", pa.int32()), ("label", pa.string()), ("start_us", pa.int64()), ("end_us", pa.int64()), ("cls", pa.string())])
    rows = [[(0, "a", 0, 10, "v"), (1, "b", 10, 20, "s")], None, [(0, None, 0, 9, "v")]]
    column = pa.array([r and [dict(zip(("pos", "label", "start_us", "end_us", "cls"), x, strict=True)) for x in r] for r in rows], pa.list_(element))
    steps = L.align_timed(*L.timed_codes(column, column.slice(0)))
    assert [[x.tolist() for x in s] for s in steps] == [[[0, 1], [0, 1]], [[], []], [[0], [0]]]
    part = column.slice(2)  # a slice keeps to its own rows
    (codes, sizes), _ = L.timed_codes(part, part)
    assert codes.shape == (4, 1) and sizes.tolist() == [1] and codes[3].tolist() == [9] and np.issubdtype(codes.dtype, np.int64)


@pytest.mark.parametrize("options", [E.Options(), E.Options(by_class=False, interior=True), E.Options(matcher="times", interior=True, drop=("uh",))])
def test_tallies_are_counters_hits_and_errors(spark, options):
    pairs = fx.pairs(spark, SMALL).where("substr(md5(utt_id), 1, 1) < '4'")
    one = [("u", "s", "c", "sys_a", "clean", [(0, "uh", 0, 5)], [(0, "x", 1, 7, 0.5)]), ("v", "s", "c", "sys_a", "clean", [(0, None, 0, 5), (1, "a", 5, 9)], [(0, "a", 4, 9, 0.5), (1, None, 9, 9, None)]), ("w", "s", "c", "sys_b", "noise", [], [])]
    pairs = pairs.unionByName(spark.createDataFrame(one, fx.PAIRS)).cache()
    a, made = E.aligned_pairs(pairs, A.classify, options).cache(), E.tallied(pairs, A.classify, options).cache()
    same = lambda x, y: sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    counted = S.counters(a)
    assert same(made.select(*counted.columns), counted)
    bounds = S.segmentation_packed(a, options.tolerance_us)
    assert same(made.select(*bounds.columns), bounds)
    errors = E.errors(a, A.classify, options)
    for edge in ("onset", "offset"):
        assert same(made.select(*S.PAIR, F.explode(edge).alias("signed_us")), errors.where(F.col("edge") == edge).select(*S.PAIR, "signed_us"))
    assert same(E.leaderboard_of(made, A.G, options), E.leaderboard(a, errors, A.G, options))
    assert {f.name for f in made.schema} & {"gold", "hyp", "steps"} == set()
