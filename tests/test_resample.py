"""Weights of replicates: exact draws, their binomial splits, Poisson draws beside them."""

import math

import numpy as np
import pytest

from cadenza.operators import metrics as M
from cadenza.operators import resample as R


def test_binomial_is_the_inverse_of_its_distribution():
    for n, p in ((1, 0.5), (7, 0.2), (40, 0.9), (1000, 0.5)):
        reached = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
        for u in np.linspace(0.001, 0.999, 97):
            assert R.binomial(n, p, u) == int(np.searchsorted(reached, u))
    assert (R.binomial(5, 0.0, 0.5), R.binomial(5, 1.0, 0.5), R.binomial(0, 0.5, 0.5), R.binomial(9, 0.5, 1.0)) == (0, 5, 0, 9)
    big = [R.binomial(10**9, 0.25, u) for u in (0.025, 0.5, 0.975)]
    assert big == pytest.approx([2.5e8 - 26_838, 2.5e8, 2.5e8 + 26_838], abs=3)


def test_draws_are_dealt_whole():
    counts = np.array([3, 0, 500, 97, 1, 1, 0, 0])
    dealt = np.array([R.deal(counts, 3, b) for b in range(2000)])
    assert (dealt.sum(axis=1) == counts.sum()).all() and (dealt[:, counts == 0] == 0).all()
    assert dealt.mean(axis=0) == pytest.approx(counts, rel=0.1, abs=0.1)
    assert dealt.var(axis=0)[2] == pytest.approx(counts.sum() * (500 / 602) * (102 / 602), rel=0.1)
    w = np.array([R.chosen(50, 50, 3, b, 0) for b in range(2000)])
    assert (w.sum(axis=1) == 50).all() and w.mean(axis=0) == pytest.approx(np.ones(50), abs=0.12) and w.var() == pytest.approx(49 / 50, rel=0.03)


@pytest.mark.parametrize("chunk", [16, 4096])
def test_exact_and_poisson(spark, chunk):
    rng = np.random.default_rng(1)
    x = rng.gamma(2, 5000, 400).astype(int)
    rows = spark.createDataFrame([(g, f"{g}{i}", int(v), 1) for g in ("g", "h") for i, v in enumerate(x)] + [(None, "lone", 5, 1)], "g string, utt_id string, s bigint, c bigint")
    sums = R.exact_sums(rows, ["g"], ["s", "c"], 100, 1, chunk).collect()
    assert len(sums) == 300 and {(r.g, r.c) for r in sums} == {("g", 400), ("h", 400), (None, 1)}  # n draws of n in every replicate
    assert {r.s for r in sums if r.g is None} == {5}
    moved = R.exact_sums(rows.repartition(7), ["g"], ["s", "c"], 100, 1, chunk).collect()
    assert sorted(map(repr, moved)) == sorted(map(repr, sums))
    plain = np.quantile([rng.choice(x, len(x)).mean() / 1000 for _ in range(2000)], [0.025, 0.975])
    for exact in (True, False):
        got = M.bootstrap(rows.where("g = 'h'"), ["g"], exact=exact).first()
        assert [got.lo, got.hi] == pytest.approx(plain, rel=0.03)
    assert R.exact_sums(rows.limit(0), ["g"], ["s", "c"], 10, 1).count() == 0 and R.poisson_sums(rows.limit(0), ["g"], ["s", "c"], 10, 1).count() == 0


def test_whole_numbers_stay_whole(spark):
    rows = spark.createDataFrame([("g", "a", 2**60, 1), ("g", "b", -3, 1)], "g string, utt_id string, s bigint, c bigint")
    keys = np.array([int(r[0]) for r in rows.select(R.id_key()).collect()])
    w = R.poisson_weights(keys, 0, np.arange(40)).astype(object)
    want = {b: int((w[:, b] * np.array([2**60, -3], object)).sum()) for b in range(40) if 2**60 * w[0, b] < 2**62}
    got = {r.b: r.s for r in R.poisson_sums(rows, ["g"], ["s", "c"], 40, 0).collect()}
    assert all(got[b] == v for b, v in want.items()) and len(want) > 30
