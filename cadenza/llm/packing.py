"""Best-fit packing by minimum bin slack.

Documents are cut into pieces of at most ``capacity`` tokens. What has to be packed is a histogram of piece lengths, at most ``capacity`` numbers
whatever the corpus: bin after bin, a bitset subset-sum dynamic programme over the lengths still available (the largest is always taken) finds the
fullest feasible combination, which is removed as often as its lengths last. The resulting plan is applied to the pieces by their rank within their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import cache_for, chunked, without_collector
from .common import materialize

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _packed(bpe, ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def cut_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """``docs(doc_id, text)`` -> a row per piece: doc_id, piece, start, length, ids_crc32 (of the little-endian 32-bit ids).

    A document's ids are its text's followed by ``end_id``; null text is empty. Only documents longer than ``capacity`` are cut, and only
    the last piece may be shorter. A map over rows; a repeated doc_id gives its pieces again.
    """

    def run(batches):
        cache, end, width = cache_for(path, _packed), np.array([end_id], "<u4").tobytes(), 4 * capacity
        with without_collector():
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for first, chunks, counts in chunked(batch.column(1)):
                    got, at = cache.values(chunks), 0
                    for k, n in enumerate(counts):
                        data = b"".join(got[at : at + n]) + end
                        at += n
                        doc = ids[first + k]
                        for piece, start in enumerate(range(0, len(data), width)):
                            part = data[start : start + width]
                            rows.append((doc, piece, start // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_pydict(
                    {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())))}
                )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths (length -> how many there are) with the largest sum <= room, larger lengths first."""
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in available if x <= room), reverse=True):
        if reach >> room & 1:
            break
        steps.append((length, reach))
        left = min(available[length], room // length)
        take = 1
        while left:  # binary splitting of the copies
            take = min(take, left)
            reach |= reach << (length * take) & full
            left, take = left - take, take * 2
    target = reach.bit_length() - 1
    used = {}
    for length, before in reversed(steps):
        n = 0
        while not before >> target & 1:
            target, n = target - length, n + 1
        if n:
            used[length] = n
    return used


def minimum_slack_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, {length: copies a bin}) for every pattern of bins. Each pattern uses up a length but for a remainder below one bin's copies."""
    left, plan = {k: n for k, n in histogram.items() if n}, []
    while left:
        largest = max(left)
        left[largest] -= 1
        if not left[largest]:
            del left[largest]
        used = fullest(left, capacity - largest)
        left[largest] = left.get(largest, 0) + 1
        used[largest] = used.get(largest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        plan.append((times, used))
    return plan


def plan_runs(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, copies a bin, first bin, first offset), sorted: which slots the pieces of a length take, by their rank within it."""
    rows, taken, bins = [], {}, 0
    for times, used in plan:
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            first = taken.get(length, 0)
            rows.append((length, first, n, bins, offset))
            taken[length] = first + n * times
            offset += n * length
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


PACKED = PIECES + ", sequence_id bigint, offset bigint"


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """``docs(doc_id, text)`` -> the pieces of ``cut_pieces`` with sequence_id and offset.

    Sequences have no gaps from offset 0. An empty table gives no rows; null text is an empty document of one token; rows with a repeated or null doc_id are
    packed each by itself. Other columns are ignored. The driver sees only the histogram of lengths, at most
    ``capacity`` numbers, and makes the plan; ranks within a length come from windows over (length, salt), as one length may hold most pieces. A piece's salt is drawn by its place when the
    pieces are written, so rows of one document and text spread like others, and a task that runs again ranks them as before.
    """
    spark = docs.sparkSession
    drawn = cut_pieces(docs, path, capacity, end_id).withColumn("draw", F.xxhash64(F.monotonically_increasing_id()))
    pieces = materialize(drawn, "pieces")
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("salt", F.pmod("draw", F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(plan_runs(minimum_slack_plan(histogram, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("draw", "doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("within", within).join(offsets, ["length", "salt"])
    ranked = ranked.select(*[c for c in pieces.columns if c != "draw"], (F.col("before") + F.col("within") - 1).alias("rank"))

    def place(batches):
        table = runs.value
        key = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = table[np.searchsorted(key, length << 44 | rank, "right") - 1]
            k = rank - run[:, 1]
            made = pa.Table.from_batches([batch]).drop_columns(["rank"])
            made = made.append_column("sequence_id", pa.array(run[:, 3] + k // run[:, 2]))
            yield from made.append_column("offset", pa.array(run[:, 4] + k % run[:, 2] * length)).to_batches()

    return ranked.mapInArrow(place, PACKED)
