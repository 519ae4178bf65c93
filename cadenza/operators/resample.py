"""Resampling of utterances: weights of every replicate from a counter-based generator, and weighted sums by matrix products over Arrow batches.

``rows`` are (group, utt_id, statistics, all whole numbers). Both kinds of weights come from hashes of seed, replicate and id, so results don't depend on partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From which of 65,536 values on a Poisson variable of mean 1 is at least 1, 2, ...
POISSON = (24110, 48219, 60274, 64292, 65297, 65498, 65531)
# fixed values: a published 32-bit finaliser
FIRST, SECOND = 2246822507, 3266489909
#: Replicates and rows worked at once; replicates dealt in one task; rows of a chunk, about; how far from the mode a binomial is searched, in deviations.
REPLICATES_AT_ONCE, ROWS_AT_ONCE, DEALT_AT_ONCE, CHUNK, SPREAD = 250, 2048, 50, 512, 10
MASK = np.uint64(0xFFFFFFFF)
#: The draw for each of the 65,536 values.
DRAWS = np.searchsorted(np.array(POISSON), np.arange(1 << 16), "right").astype(np.uint8)


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers that spreads every bit over all."""
    x = np.asarray(x, np.uint64) & MASK
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(FIRST)) & MASK
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(SECOND)) & MASK
    return x ^ (x >> np.uint64(16))


def id_key(name: str = "utt_id") -> Column:
    """32 bits of an id's MD5."""
    return F.conv(F.substring(F.md5(F.col(name)), 1, 8), 16, 10).cast("bigint")


def poisson_weights(keys: np.ndarray, seed: int, replicates: np.ndarray) -> np.ndarray:
    """Rows x replicates, each a Poisson draw of mean 1: ``mix32`` in 32-bit numbers, which wrap, and the draw of its upper half from a table."""
    x = (keys.astype(np.uint64) & MASK).astype(np.uint32)[:, None] ^ mix32(replicates.astype(np.uint64) + np.uint64(seed)).astype(np.uint32)[None, :]
    for by, factor in ((16, FIRST), (13, SECOND)):
        x ^= x >> np.uint32(by)
        x *= np.uint32(factor)
    return DRAWS[x >> np.uint32(16)]  # the last step of mix32 leaves the upper half alone


def _weighed(weights: np.ndarray, values: np.ndarray) -> np.ndarray:
    """weights' @ values in whole numbers: by floating point where all sums are exact there."""
    exact = float(np.abs(values).max(initial=0)) * float(weights.sum(axis=0, dtype=np.int64).max(initial=0)) < 2**53
    return (weights.T.astype(np.float64) @ values.astype(np.float64)).astype(np.int64) if exact else weights.T.astype(np.int64) @ values


def _codes(batch: pa.RecordBatch, group: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """A number for each row's group, and the groups."""
    if not group:
        return np.zeros(batch.num_rows, np.int64), [()]
    joined = pc.binary_join_element_wise(*[pc.fill_null(pc.binary_join_element_wise(batch.column(g).cast(pa.string()), "1", ""), "0") for g in group], "\0").dictionary_encode()
    codes = joined.indices.to_numpy()
    _, first = np.unique(codes, return_index=True)
    return codes, [tuple(batch.column(g)[int(i)].as_py() for g in group) for i in first]


def _emit(held: dict[tuple, np.ndarray], group: list[str], types: list[pa.DataType], stats: list[str], replicates: np.ndarray):
    for name, sums in held.items():
        n = len(replicates)
        columns = [pa.array([v] * n, t) for v, t in zip(name, types, strict=True)] + [pa.array(replicates.astype(np.int32))] + [pa.array(sums[:, k]) for k in range(len(stats))]
        yield pa.RecordBatch.from_arrays(columns, [*group, "b", *stats])


def _schema(rows: DataFrame, group: list[str], stats: list[str]) -> str:
    return ", ".join([*(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group), "b int", *(f"`{s}` bigint" for s in stats)])


def poisson_sums(rows: DataFrame, group: list[str], stats: list[str], replicates: int, seed: int) -> DataFrame:
    """group, b, statistics: each replicate's sums, rows weighed by Poisson draws. A task gives ``replicates`` rows a group, whatever it has read; an id's draws are made once for all its rows in a batch."""
    keyed = rows.select(*group, id_key().alias("_key"), *[F.col(s).cast("bigint").alias(s) for s in stats])

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        types = None
        for batch in batches:
            types = [batch.column(g).type for g in group]
            codes, names = _codes(batch, group)
            keys = batch.column("_key").to_numpy()
            values = np.column_stack([batch.column(s).to_numpy(zero_copy_only=False) for s in stats]).astype(np.int64)
            sums = [held.setdefault(name, np.zeros((replicates, len(stats)), np.int64)) for name in names]
            distinct, own = np.unique(keys, return_inverse=True)
            order = np.lexsort((codes, own // ROWS_AT_ONCE))  # block by block of ids, group by group in each
            cuts = np.append(np.flatnonzero(np.diff(own[order] // ROWS_AT_ONCE * len(names) + codes[order], prepend=-1)), len(order)).tolist()
            for a in range(0, len(distinct), ROWS_AT_ONCE):
                parts = [order[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True) if own[order[i]] // ROWS_AT_ONCE == a // ROWS_AT_ONCE]
                for r in range(0, replicates, REPLICATES_AT_ONCE):
                    these = np.arange(r, min(r + REPLICATES_AT_ONCE, replicates))
                    weights = poisson_weights(distinct[a : a + ROWS_AT_ONCE], seed, these)
                    for some in parts:
                        sums[codes[some[0]]][these] += _weighed(weights[own[some] - a], values[some])
        yield from _emit(held, group, types or [], stats, np.arange(replicates))

    parts = keyed.mapInArrow(run, _schema(rows, group, stats))
    return parts.groupBy(*group, "b").agg(*[F.sum(s).alias(s) for s in stats])


def binomial(n: int, p: float, u: float) -> int:
    """The value at which the distribution function of a binomial variable reaches ``u``; sums start SPREAD deviations below the mode."""
    if n == 0 or p <= 0 or p >= 1:
        return n if p >= 1 else 0
    mode, half = math.floor((n + 1) * p), math.ceil(SPREAD * math.sqrt(n * p * (1 - p))) + SPREAD
    low, high = max(0, mode - half), min(n, mode + half)
    at = math.exp(math.lgamma(n + 1) - math.lgamma(mode + 1) - math.lgamma(n - mode + 1) + mode * math.log(p) + (n - mode) * math.log(1 - p))
    up, down = np.arange(mode, high), np.arange(mode, low, -1)
    above = at * np.cumprod((n - up) / (up + 1) * (p / (1 - p)))
    below = at * np.cumprod(down / (n - down + 1) * ((1 - p) / p))
    reached = np.cumsum(np.concatenate([below[::-1], [at], above]))
    return min(high, low + int(np.searchsorted(reached, u, "left")))


def uniform(seed: int, replicate: int, node: int) -> float:
    """53 bits for a node of the tree of ranges."""
    base = int(mix32(mix32(np.uint64(seed + replicate)) ^ mix32(np.uint64(node))))
    a, b = (int(mix32(np.uint64(base + k))) for k in (1, 2))
    return ((a >> 5) * 2**26 + (b >> 6)) / 2**53


def deal(counts: np.ndarray, seed: int, replicate: int) -> np.ndarray:
    """As many draws as there are rows, dealt to ranges of ``counts`` rows: from the root each half gets a binomial share of its parent's draws. len(counts) is a power of 2."""
    levels = [counts]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
    draws = np.array([counts.sum()])
    for level, half in enumerate(levels[-2::-1]):
        split = half.reshape(-1, 2)
        left = np.array([binomial(int(d), m[0] / m.sum() if m.sum() else 0.0, uniform(seed, replicate, 2**level + q + 2**24)) for q, (d, m) in enumerate(zip(draws, split, strict=True))])
        draws = np.column_stack([left, draws - left]).ravel()
    return draws


def chosen(draws: int, rows: int, seed: int, replicate: int, chunk: int) -> np.ndarray:
    """How often each of a chunk's rows is drawn."""
    base = mix32(mix32(np.uint64(seed + replicate)) ^ np.uint64(chunk))
    x = mix32(base + np.arange(draws, dtype=np.uint64) * np.uint64(2654435769))
    return np.bincount(((x * np.uint64(rows)) >> np.uint64(32)).astype(np.int64), minlength=rows)


def exact_sums(rows: DataFrame, group: list[str], stats: list[str], replicates: int, seed: int, chunk: int = CHUNK) -> DataFrame:
    """group, b, statistics: each replicate's sums over n draws, with replacement, of a group's n rows.

    Rows fall into ranges of their ids' hash, as many as give about ``chunk`` rows in each. A replicate's n draws are dealt down the tree of ranges by binomial splits, then to
    the rows of a range in order of hash and id. So weights sum to n exactly, though rows are never numbered over a group. ``rows`` is read twice: pass a staged table.
    """
    most = rows.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(most / chunk))) if most else 0
    held = F.struct(F.col("_key").alias("h"), F.col("utt_id"), *[F.col(s).cast("bigint").alias(s) for s in stats])
    keyed = rows.withColumn("_key", id_key()).withColumns({"_chunk": F.shiftright("_key", 32 - bits).cast("bigint"), "_g": F.to_json(F.struct(F.lit(1).alias("_"), *group))})
    chunks = keyed.groupBy("_g", *group, "_chunk").agg(F.array_sort(F.collect_list(held)).alias("rows"))
    counts = keyed.groupBy("_g", "_chunk").agg(F.count("*").alias("n")).groupBy("_g").agg(F.collect_list(F.struct("_chunk", "n")).alias("counts"))
    counts = counts.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(DEALT_AT_ONCE)))).repartition("_g", "first")

    def dealt(batches):
        for batch in batches:
            for g, first, found in zip(batch.column("_g").to_pylist(), batch.column("first").to_pylist(), batch.column("counts"), strict=True):
                where, n = found.values.field("_chunk").to_numpy(), found.values.field("n").to_numpy()
                full = np.zeros(1 << bits, np.int64)
                full[where] = n
                draws = np.array([deal(full, seed, b) for b in range(first, min(first + DEALT_AT_ONCE, replicates))])
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(where)), pa.array(where), pa.array([first] * len(where), pa.int32()), pa.array(draws[:, where].T.tolist(), pa.list_(pa.int64()))], ["_g", "_chunk", "first", "draws"])

    plan = counts.mapInArrow(dealt, "_g string, _chunk bigint, first int, draws array<bigint>")

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        types = None
        for batch in batches:
            types = [batch.column(g).type for g in group]
            names = list(zip(*(batch.column(g).to_pylist() for g in group), strict=True)) if group else [()] * batch.num_rows
            for name, where, first, draws, found in zip(names, batch.column("_chunk").to_pylist(), batch.column("first").to_pylist(), batch.column("draws").to_pylist(), batch.column("rows"), strict=True):
                values = np.column_stack([found.values.field(s).to_numpy(zero_copy_only=False) for s in stats]).astype(np.int64)
                weights = np.column_stack([chosen(d, len(values), seed, first + k, where) for k, d in enumerate(draws)])
                sums.setdefault(name, np.zeros((replicates, len(stats)), np.int64))[first : first + len(draws)] += _weighed(weights, values)
        yield from _emit(sums, group, types or [], stats, np.arange(replicates))

    parts = chunks.join(plan, ["_g", "_chunk"]).mapInArrow(run, _schema(rows, group, stats))
    return parts.groupBy(*group, "b").agg(*[F.sum(s).alias(s) for s in stats])
