"""Active speech level against a plain sample-by-sample meter, known answers, slices, and cells of the path protocol."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import pathscore as P
from cadenza.operators import waveform as W


def plain_level(x, rate):
    """The meter as it's defined, one sample at a time."""
    g, hang = math.exp(-1 / (rate * 0.03)), math.ceil(rate * 0.2)
    p = q = 0.0
    counts, last = {2.0**k: 0 for k in range(-16, 0)}, {}
    for n, v in enumerate(x):
        p = g * p + (1 - g) * abs(v)
        q = g * q + (1 - g) * p
        for c in counts:
            if q >= c:
                last[c] = n
            counts[c] += c in last and n - last[c] <= hang
    sq = sum(v * v for v in x)
    points = sorted((10 * math.log10(sq / n) - 20 * math.log10(c), 10 * math.log10(sq / n)) for c, n in counts.items() if n)
    return 10 ** (float(np.interp(15.9, [d for d, _ in points], [v for _, v in points])) / 10)


@pytest.mark.parametrize("rate", [100, 1000, 16_000])
def test_meter_equals_plain(rate):
    rng = np.random.default_rng(rate)
    x = rng.normal(size=3000) * 0.2 * (np.sin(np.arange(3000) / 300) > 0)
    level = W.SpeechLevel(rate)
    for part in np.split(x, [1, 7, 900, 901, 2500]):
        level.add(part)
    assert level.power() == pytest.approx(plain_level(x, rate), rel=1e-9)


def test_many_meters_share_their_filters():
    meters = [W.SpeechLevel(100) for _ in range(50)]
    assert len({id(s.response) for m in meters for s in m.smoothers}) == 1  # half a megabyte each, for every row of a batch


def test_equally_distant_thresholds_go_by_the_lowest():
    for energy in (1 - 1e-8, 1.0, 1 + 1e-8):  # 64 samples reach 2**-6 and one reaches 2**-3: equal distances, levels 18 dB apart
        level = W.SpeechLevel(100)
        level.active, level.energy, level.n = np.array([64] * 11 + [63, 62, 1, 0, 0]), energy, 64
        assert level.power() == pytest.approx(0.0157146, rel=1e-4)


def test_known_answers():
    rate = 16_000
    tone = 0.5 * np.sin(2 * np.pi * 440 * np.arange(10 * rate) / rate)
    whole, half = W.speech_power(tone, rate), W.speech_power(np.concatenate([np.zeros(10 * rate), tone]), rate)
    assert whole == pytest.approx(0.125, rel=0.02)
    assert 10 * math.log10(half / (np.concatenate([np.zeros(10 * rate), tone]) ** 2).mean()) == pytest.approx(3.01, abs=0.1)  # silence doesn't count
    assert W.speech_power(np.zeros(100), rate) == 0 and W.speech_power(np.zeros(0), rate) == 0
    assert W.speech_power(np.full(100, 1e-7), rate) == pytest.approx(1e-14)  # under every threshold: everything counts
    assert W.speech_power(np.concatenate([np.zeros(3200), np.full(3200, 0.1)]), rate, "frames") == pytest.approx(0.01)
    with pytest.raises(ValueError):
        W.speech_power(tone, rate, "loudest")


def test_sliding_max():
    x = np.random.default_rng(1).normal(size=50)
    for width in (1, 2, 7, 50):
        assert W.sliding_max(x, width).tolist() == [x[i : i + width].max() for i in range(51 - width)]


def test_levels_of_slices(spark):
    x = np.random.default_rng(0).normal(size=1000) * 0.1
    whole = spark.createDataFrame([("a", 0, x.tolist())], "rec string, part int, samples array<double>")
    parts = spark.createDataFrame([("a", k, x[k * 100 : k * 100 + 100].tolist()) for k in range(10)] + [("b", 0, None), ("b", 1, []), ("c", 0, [0.0] * 5)], "rec string, part int, samples array<double>")
    one = W.active_levels(whole, ["rec"], 1000).first()
    got = {r["rec"]: r for r in W.active_levels(parts.repartition(7), ["rec"], 1000, "part").collect()}
    assert got["a"]["power"] == pytest.approx(one["power"], rel=1e-12) and got["a"]["n_samples"] == 1000
    assert (got["b"]["n_samples"], got["b"]["power"], got["b"]["level_db"]) == (0, 0.0, None) and got["c"]["power"] == 0
    assert W.active_levels(parts.limit(0), ["rec"], 1000, "part").count() == 0


def test_mix_goes_by_active_speech(spark):
    rng = np.random.default_rng(3)
    speech, noise = np.concatenate([np.zeros(8000), 0.3 * np.sin(np.arange(8000))]), rng.normal(size=20_000)
    plan = spark.createDataFrame([("i", speech.tolist(), noise.tolist(), 10.0), ("quiet", speech.tolist(), [0.0] * 16_000, 10.0)], "item_id string, speech array<double>, noise array<double>, snr_db double")
    got = {r["item_id"]: r for r in W.mix(plan, 16_000).collect()}
    added = np.array(got["i"]["samples"]) - speech
    assert len(added) == len(speech) and 10 * math.log10(W.speech_power(speech, 16_000) / (added**2).mean()) == pytest.approx(10)
    assert (speech**2).mean() / (added**2).mean() < 7  # by the whole signal's power the noise would be 3 dB quieter
    assert got["quiet"]["scale"] == 0 and got["quiet"]["snr_db"] is None
    pair = spark.createDataFrame([("i", speech.tolist(), added.tolist())], "item_id string, speech array<double>, noise array<double>")
    assert W.measure_snr(pair, 16_000).first()["snr_db"] == pytest.approx(10)


def test_cells_count_what_was_attempted(spark):
    tier = lambda rows: spark.createDataFrame(rows, "system string, utt_id string")
    gold = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "utt_id string")
    hyp = tier([("a", "u1"), ("a", "u2"), ("a", "u9"), ("b", "u1"), ("b", "u2"), ("c", "u1"), ("d", "u9")])
    tried = P.attempts(gold, hyp, ["system"])
    steps = [(0, "sil", 0, "sil", 0), (1, "t", 100, "t", 130), (2, "a", 200, "a", 190)]
    rows = [(s, "u1", *x) for s in ("a", "c") for x in steps]
    results = P.packed(spark.createDataFrame(rows, "system string, utt_id string, step int, ref_label string, ref_us long, test_label string, test_us long"), ["system", "utt_id"])
    families = spark.createDataFrame([("a", "x"), ("b", "x"), ("d", "x"), ("d", "x")], "system string, family string")
    same = lambda ref, test: (ref, test)
    got = {r["system"]: r.asDict() for r in P.score_cells(results, tried, families, same, ["system"]).collect()}
    assert (got["a"]["state"], got["a"]["n"], got["a"]["n_attempted"], got["a"]["n_failed"]) == ("scored", 2, 2, 1)  # u3 has no hypothesis, u9 no reference
    assert (got["b"]["state"], got["b"]["n"], got["b"]["n_attempted"], got["b"]["n_failed"]) == ("failed", None, 2, 2)
    assert (got["c"]["state"], got["c"]["n"], got["c"]["n_failed"]) == ("skipped", None, None)
    assert (got["d"]["state"], got["d"]["n_attempted"], got["d"]["n_failed"]) == ("empty", 0, 0)
    assert P.score_cells(results.limit(0), tried.limit(0), families, same, ["system"]).count() == 0
    assert results.select(F.size("path")).first()[0] == 3
