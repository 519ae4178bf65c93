"""Leaderboards with intervals from one Arrow job over pairs: what is counted there is what the long tables give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import metrics as M
from cadenza.operators import resample as R
from cadenza.operators import score as E
from cadenza.operators import scoring as S
from cadenza.operators.align import align_labels
from cadenza.plans import alignment as A
from cadenza.plans import fixtures as fx
from cadenza.sources.storage import stage

SMALL = "/root/testdata/sf0.001"
ODD = [
    ("v", "s", "c", "sys_a", "clean", [(0, None, 0, 5), (1, "a", 5, None), (2, "m", 9, 30_000)], [(0, "a", 4, 9, 0.5), (1, None, 9, 9, None), (2, "n", 10, 60_000, 0.25)]),
    ("v", "s", "c", "sys_b", "clean", [(0, None, 0, 5), (1, "a", 5, None), (2, "m", 9, 30_000)], [(0, "e", 1, 9, float("nan")), (1, "a", 9, 9, 0.5)]),
    ("w", "s", "c", "sys_b", "noise", [], []), ("x", "s", "d", "sys_a", "clean", [(0, "a", 0, 5)], [(0, "t", 0, 5, 0.5)]),
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(x, y):
    return sorted(map(str, x.collect())) == sorted(map(str, y.select(*x.columns).collect()))


def test_pooled_rows_and_their_counts_are_those_of_long_tables(spark, monkeypatch):
    pairs = stage(fx.pairs(spark, SMALL).where("substr(md5(utt_id), 1, 1) < '4'").unionByName(spark.createDataFrame(ODD, fx.PAIRS)), "pairs")
    pairs = pairs.coalesce(1).sortWithinPartitions("cond", "utt_id")  # one batch: all systems of an utterance together
    a = E.aligned_pairs(pairs, A.classify).cache()
    e = E.errors(a, A.classify).cache()
    made = stage(pairs.mapInArrow(S.pooled_batches(A.class_of), S.POOLED), "pooled")
    for expected in (S.counters(a), S.segmentation_packed(a)):
        assert same(expected, made)
    for edge in ("onset", "offset"):
        rows = made.select(*S.PAIR, F.explode(F.arrays_zip("conf", edge)).alias("x")).select(*S.PAIR, "x.conf", F.col(f"x.{edge}").alias("signed_us"))
        assert same(e.where(F.col("edge") == edge).select(*S.PAIR, "conf", "signed_us"), rows)
    keys = ["cond", "utt_id"]
    common = e.join(S.common_matched(e, keys), [*keys, "gold_idx"], "left_semi")
    for held in (S.COUNTS_HELD, 50):  # a task that passes its counts on early, too
        monkeypatch.setattr(S, "COUNTS_HELD", held)
        counts = S.counted_errors(made, A.G).cache()
        assert counts.count() == counts.select(*A.G, "conf", "abs_us").distinct().count() < e.count()
        assert same(M.summary(e, A.G), M.counted_summary(counts, A.G))
        assert same(common.groupBy(*A.G).agg(F.count("*").alias("n_common"), M.mean_ms(F.col("abs_us")).alias("mae")), M.counted_mean(counts.where("n_common > 0"), A.G, "n_common", "mae"))
        assert same(E.leaderboard(a, e, A.G), E.leaderboard_of_counts(made, counts, A.G))
    within = F.sum(F.coalesce(F.col("abs_us") <= A.PRIMARY_US, F.lit(False)).cast("bigint")).alias("n_within")
    per = e.groupBy(*A.G, "utt_id").agg(F.coalesce(F.sum("abs_us"), F.lit(0)).alias("abs_us"), within, F.count("*").alias("n_errors"))
    assert same(per, made.where("n_errors > 0"))


@pytest.mark.parametrize("query", [A.leaderboard_full, A.leaderboard_whole])
def test_one_job_from_turns_to_rows_of_pairs(spark, monkeypatch, query):
    held, real = [], A.stage
    monkeypatch.setattr(A, "stage", lambda df, label: held.append(df) or real(df, label))
    query(spark, SMALL)
    assert plan(held[0]).count("MapInArrow") == 1 and "Generate" not in plan(held[0]) and {"gold", "hyp", "steps", "edge"}.isdisjoint(held[0].columns)
    assert all("Generate" not in plan(df) for df in held) and len(held) == 2  # no row an error


def test_an_id_has_one_weight_in_all_groups(spark, monkeypatch):
    keys = np.array([0, 1, 2**31, 2**32 - 1, 123456789])
    v = R.mix32(keys.astype(np.uint64)[:, None] ^ R.mix32(np.arange(60, dtype=np.uint64) + np.uint64(7))[None, :]) >> np.uint64(16)
    assert (R.poisson_weights(keys, 7, np.arange(60)) == np.searchsorted(np.array(R.POISSON, np.uint64), v, "right")).all()
    rows = [(g, f"u{i}", i * k + 1, 1) for i in range(300) for k, g in enumerate("abc") if (i + k) % 4]
    t = spark.createDataFrame(rows, "g string, utt_id string, s bigint, c bigint").coalesce(1)
    monkeypatch.setattr(R, "ROWS_AT_ONCE", 64)
    alone = [r for g in "abc" for r in R.poisson_sums(t.where(F.col("g") == g), ["g"], ["s", "c"], 30, 7).collect()]
    assert sorted(map(str, R.poisson_sums(t, ["g"], ["s", "c"], 30, 7).collect())) == sorted(map(str, alone))


def test_common_matches_are_summed_where_pairs_are_made(spark):
    made = A.common_matched(spark, SMALL)
    assert plan(made).count("MapInArrow") == 1 and plan(made).count("Exchange") == plan(fx.pairs(spark, SMALL)).count("Exchange") + 1 and "Window" not in plan(made) and "Generate" not in plan(made)
    one = [(*ODD[0][:5], [(0, "a", 0, 5), (1, "a", 5, None), (2, None, 9, 9)], [(0, "a", 4, 9, 0.5), (1, "a", 9, 9, None), (2, None, 9, 9, 0.5)]), (*ODD[1][:5], [(0, "a", 0, 5), (1, "a", 5, None), (2, None, 9, 9)], [(0, "a", 1, 9, 0.5), (1, "a", 9, 9, 0.5)]), *ODD[2:]]
    pairs = stage(fx.pairs(spark, SMALL).where("substr(md5(utt_id), 1, 1) < '4'").unionByName(spark.createDataFrame(one, fx.PAIRS)), "pairs").coalesce(1).sortWithinPartitions("cond", "utt_id")
    kept = S.boundary_errors(S.common_steps(align_labels(pairs), ["cond", "utt_id"]), A.classify, F.col("common"))
    expected = kept.groupBy(*A.G).agg(F.count("*").alias("n"), F.count("abs_us").alias("n_timed"), F.sum("abs_us").alias("abs_us"))
    got = pairs.mapInArrow(S.common_batches(tuple(A.G)), S.common_schema(tuple(A.G))).groupBy(*A.G).agg(*[F.sum(c).alias(c) for c in ("n", "n_timed", "abs_us")])
    assert same(expected, got) and got.where("corpus = 'c' and n_timed < n").count() == 2
