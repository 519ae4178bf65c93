"""Waveform jobs: active speech level, additive mixing at a target SNR, its re-measurement, frame energies. Waveforms are rows (utt_id, samples array<double>)."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values of the speech voltmeter: time constant and hangover in seconds, margin in dB, thresholds in powers of 2 of full scale
TIME_CONSTANT, HANGOVER, MARGIN, BITS = 0.03, 0.2, 15.9, 16
#: Samples filtered at once; length of a frame in seconds and how far below the loudest one a frame still counts, where levels go by frames.
BLOCK, FRAME, FRAME_FLOOR = 256, 0.02, 1e-4


def frames(waves: DataFrame, key: list[str], size: int, hop: int) -> DataFrame:
    """Energy of each frame: key, frame, at (first sample), power (mean square). Waveforms shorter than a frame give none."""
    starts = F.sequence(F.lit(0), F.size("samples") - size, F.lit(hop))
    f = waves.where(F.size("samples") >= size).select(*key, "samples", F.posexplode(starts).alias("frame", "at"))
    power = F.aggregate(F.slice("samples", F.col("at") + 1, size), F.lit(0.0), lambda a, x: a + x * x) / size
    return f.select(*key, "frame", "at", power.alias("power"))


def active_power(waves: DataFrame, key: list[str], size: int, floor: float = FRAME_FLOOR) -> DataFrame:
    """Mean power of the frames within ``floor`` of the loudest one: key, n_active, power."""
    f = frames(waves, key, size, size)
    peak = f.groupBy(*key).agg(F.max("power").alias("peak"))
    return f.join(peak, key).where(F.col("power") >= F.col("peak") * floor).groupBy(*key).agg(F.count("*").alias("n_active"), F.avg("power").alias("power"))


@lru_cache(maxsize=4)
def responses(g: float) -> tuple[np.ndarray, np.ndarray]:
    """A block's response to its samples, 512 KB, and how the value before it fades: held once a worker, as all recordings of a rate share them."""
    k = np.arange(BLOCK)
    return np.where(k[:, None] >= k, (1 - g) * g ** np.maximum(k[:, None] - k, 0), 0.0).T, g ** (k + 1)


class Smoother:
    """y[n] = g y[n-1] + (1 - g) x[n], block by block: within a block by one matrix product, from block to block by what is left of the last value."""

    def __init__(self, g: float):
        self.last = 0.0
        self.response, self.fading = responses(g)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rows, wide = -(-len(x) // BLOCK), min(len(x), BLOCK)
        y = np.zeros((rows, wide))
        y.ravel()[: len(x)] = x
        y = y @ self.response[:wide, :wide]
        for r in range(rows):
            y[r] += self.last * self.fading[:wide]
            self.last = float(y[r, -1])
        y = y.ravel()[: len(x)]
        self.last = float(y[-1]) if len(x) else self.last
        return y


def sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    """The largest of each ``width`` values in a row: from maxima up to and since the borders of blocks of that width."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    blocks = np.full((rows, width), -np.inf)
    blocks.ravel()[: len(x)] = x
    since = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    upto = np.maximum.accumulate(blocks, axis=1).ravel()
    return np.maximum(since[:n], upto[width - 1 : width - 1 + n])


class SpeechLevel:
    """Active speech level of a recording that comes in slices: what it keeps between them is two filters' last values and the envelope over one hangover.

    The rectified signal goes through two smoothers; for every threshold, samples count as active while the envelope was at or above it within the hangover. The level over
    these samples falls as the threshold rises; where it is MARGIN above the threshold lies the active level, by interpolation, or at the nearer end where it never is.
    Thresholds that lie equally far below their levels (their counts differ by a power of 4) are told by whole numbers, and the lowest of them stands for all.
    """

    def __init__(self, rate: float):
        g = math.exp(-1 / (rate * TIME_CONSTANT))
        self.smoothers = Smoother(g), Smoother(g)
        self.hang = math.ceil(rate * HANGOVER)
        self.tail = np.full(self.hang, -1.0)
        self.thresholds = 2.0 ** np.arange(-BITS, 0)
        self.active = np.zeros(BITS, np.int64)
        self.energy, self.n = 0.0, 0

    def add(self, x: np.ndarray) -> None:
        if not len(x):
            return
        self.energy += float(x @ x)
        self.n += len(x)
        envelope = np.concatenate([self.tail, self.smoothers[1](self.smoothers[0](np.abs(x)))])
        reached = np.searchsorted(self.thresholds, sliding_max(envelope, self.hang + 1), "right")  # thresholds at or below
        self.active += len(x) - np.cumsum(np.bincount(reached, minlength=BITS + 1))[:BITS]
        self.tail = envelope[len(envelope) - self.hang :]

    def power(self) -> float:
        """Mean square over active speech; over everything where no threshold is reached; 0 for silence."""
        if self.energy <= 0:
            return 0.0
        some = np.flatnonzero(self.active)
        if not len(some):
            return self.energy / self.n
        some = some[np.unique(self.active[some] << 2 * some, return_index=True)[1]][::-1]  # counts times squared thresholds: the larger, the less a level lies above
        level = 10 * np.log10(self.energy / self.active[some])
        above = level - 20 * np.log10(self.thresholds[some])
        return float(10 ** (np.interp(MARGIN, above, level) / 10))


def frame_level(x: np.ndarray, rate: float) -> float:
    """Mean square of the frames of FRAME seconds within FRAME_FLOOR of the loudest; of everything where there isn't one frame."""
    size = max(1, int(FRAME * rate))
    whole = len(x) // size * size
    if not whole:
        return float((x * x).mean()) if len(x) else 0.0
    power = (x[:whole] ** 2).reshape(-1, size).mean(axis=1)
    return float(power[power >= power.max() * FRAME_FLOOR].mean())


def speech_power(x: np.ndarray, rate: float, method: str = "active") -> float:
    """Power of the speech in ``x``: its active level, or by frames where that is 0 or ``method`` is ``frames``."""
    if method not in ("active", "frames"):
        raise ValueError(f"unknown method {method!r}")
    level = SpeechLevel(rate)
    if method == "active":
        level.add(x)
    return level.power() or frame_level(x, rate)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column without copies; none for null."""
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _db(p: float) -> float | None:
    return 10 * math.log10(p) if p > 0 else None


def active_levels(slices: DataFrame, key: list[str], rate: float, order: str | None = None) -> DataFrame:
    """``slices(key, samples)``, with ``order`` (part numbers of a recording) several a key -> key, n_samples, power, level_db of its active speech.

    A recording's slices are dealt to one task, which reads them in order and keeps only the meter's state, so a recording of any length needs the memory of a slice.
    Slices of ties in ``order`` go by their samples. Null or empty ones count as no samples. A silent recording has power 0 and no level.
    """
    by = [*key, *([order] if order else [])]
    rows = slices.select(*by, F.coalesce(F.col("samples").cast("array<double>"), F.array().cast("array<double>")).alias("samples"))
    rows = rows.repartition(*key).sortWithinPartitions(*by, "samples") if order else rows
    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in key]
    types = [pa.int64(), pa.float64(), pa.float64()]

    def run(batches):
        held, meter = None, None

        def result(name, meter):  # figures only: a batch has thousands of meters
            power = meter.power()
            return (*name, meter.n, power, _db(power))

        def done(made):
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate([*held_types, *types])]
            return pa.RecordBatch.from_arrays(columns, [*key, "n_samples", "power", "level_db"])

        held_types = None
        for batch in batches:
            held_types = [batch.column(k).type for k in key]
            out = []
            for name, x in zip(zip(*(batch.column(k).to_pylist() for k in key), strict=True), _vectors(batch.column("samples")), strict=True):
                if meter is None or name != held or order is None:
                    if meter is not None:
                        out.append(result(held, meter))
                    held, meter = name, SpeechLevel(rate)
                meter.add(x)
            yield done(out)
        if meter is not None:
            yield done([result(held, meter)])

    return rows.mapInArrow(run, ", ".join([*kinds, "n_samples bigint, power double, level_db double"]))


MIXED = "item_id string, samples array<double>, scale double, snr_db double"


def mix(plan: DataFrame, rate: float, method: str = "active") -> DataFrame:
    """``plan(item_id, speech, noise, snr_db)`` (arrays of double) -> item_id, samples, scale, snr_db as measured.

    The noise, cut to the speech's length, is scaled by sqrt(P speech / 10^(snr/10) / P noise), where the speech's power is that of its active speech (``method`` ``frames``: of its loud
    frames) and the noise's that of all it has. Silent noise has scale 0 and a null SNR. Noise shorter than the speech fails the job. An Arrow job: each row by itself.
    """

    def run(batches):
        for batch in batches:
            ids, asked = batch.column("item_id"), batch.column("snr_db").to_pylist()
            made, scales, got = [], [], []
            for i, s, n, snr in zip(ids, _vectors(batch.column("speech")), _vectors(batch.column("noise")), asked, strict=True):
                if len(n) < len(s):
                    raise ValueError(f"{i}: speech has {len(s)} samples, noise {len(n)}")
                n = n[: len(s)]
                ps, pn = speech_power(s, rate, method), float((n * n).mean()) if len(n) else 0.0
                scale = math.sqrt(ps / 10 ** (snr / 10) / pn) if pn > 0 else 0.0
                added = scale * n
                power = float((added * added).mean()) if len(added) else 0.0
                made.append(s + added)
                scales.append(scale)
                got.append(_db(ps / power) if power > 0 else None)
            offsets = np.cumsum([0, *map(len, made)], dtype=np.int32)
            samples = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(made) if made else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([ids, samples, pa.array(scales, pa.float64()), pa.array(got, pa.float64())], ["item_id", "samples", "scale", "snr_db"])

    return plan.select("item_id", "speech", "noise", "snr_db").mapInArrow(run, MIXED)


def measure_snr(pairs: DataFrame, rate: float, method: str = "active") -> DataFrame:
    """``pairs(item_id, speech, noise)`` -> item_id, snr_db: active speech against all of the noise as it was added. Null where either is silent."""

    def run(batches):
        for batch in batches:
            out = []
            for s, n in zip(_vectors(batch.column("speech")), _vectors(batch.column("noise")), strict=True):
                ps, pn = speech_power(s, rate, method), float((n * n).mean()) if len(n) else 0.0
                out.append(_db(ps / pn) if pn > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(out, pa.float64())], ["item_id", "snr_db"])

    return pairs.select("item_id", "speech", "noise").mapInArrow(run, "item_id string, snr_db double")
