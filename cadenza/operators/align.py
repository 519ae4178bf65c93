"""Global alignment of label sequences, as an Arrow-batched job over a table of pairs.

The recurrence of a pair has no set-based form, so whole batches of pairs run at once in numpy: pairs are sorted by size, padded together and swept row by row.
Ties go to the diagonal, then to a gold-only step, then to a hypothesis-only one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells of the padded matrices that are held at once.
CELLS = 8_000_000
#: Costs by time, in millionths, so that sums are whole and ties exact.
LABEL_COST, CLASS_COST, SWAP_COST, INDEL_COST = 0, 500_000, 2_000_000, 1_000_000

STEPS = ArrayType(StructType([StructField("g", IntegerType()), StructField("h", IntegerType())]))


def _batches(n: np.ndarray, m: np.ndarray, share: int = 1):
    """Groups of pairs, of like size, whose padded matrices fit into CELLS / share."""
    order, start = np.lexsort((m, n)), 0
    while start < len(order):
        end, wide, high = start, 0, 0
        while end < len(order):
            w, h = max(wide, m[order[end]]), max(high, n[order[end]])
            if end > start and (end - start + 1) * (w + 1) * (h + 1) > CELLS // share:
                break
            wide, high, end = w, h, end + 1
        yield order[start:end], high, wide
        start = end


def _trace(n, m, move):
    """Steps of each pair from its end back to its start; ``move(i, j)`` gives 0 diagonal, 1 gold only, 2 hypothesis only for the running pairs."""
    i, j = n.copy(), m.copy()
    back_g, back_h = [], []
    while True:
        run = (i > 0) | (j > 0)
        if not run.any():
            break
        kind = np.where(run, move(i, j), 3)
        g, h = kind < 2, (kind == 0) | (kind == 2)
        back_g.append(np.where(g, i - 1, -1))
        back_h.append(np.where(h, j - 1, -1))
        i, j = i - g, j - h
    if not back_g:
        return [(np.zeros(0, int), np.zeros(0, int))] * len(n)
    back_g, back_h = np.array(back_g)[::-1], np.array(back_h)[::-1]
    out = []
    for k in range(len(n)):
        used = (back_g[:, k] >= 0) | (back_h[:, k] >= 0)
        out.append((back_g[used, k], back_h[used, k]))
    return out


def label_codes(*columns: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(numbers of all labels, how many each row has) of each list column of texts, or of structs with a label; one label has one number in all of them. Null rows are empty."""
    return numbered_labels(*columns)[0]


def numbered_labels(*columns: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str | None]]:
    """``label_codes``, and the label of each number."""
    flat = [c.flatten() for c in columns]
    flat = [f.field("label") if pa.types.is_struct(f.type) else f for f in flat]
    numbers = pa.chunked_array([f.cast(pa.string()) for f in flat], pa.string()).combine_chunks().dictionary_encode(null_encoding="encode")
    coded = numbers.combine_chunks() if isinstance(numbers, pa.ChunkedArray) else numbers
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.cumsum([len(f) for f in flat])
    return [(part, c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) for part, c in zip(np.split(numbers, cuts[:-1]), columns, strict=True)], coded.dictionary.to_pylist()


def align_label_batch(gold: list[list[str]], hyp: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair the gold and hypothesis index of every step, -1 where one side is missing."""
    return align_codes(*label_codes(*(pa.array(side, pa.list_(pa.string())) for side in (gold, hyp))))


def align_codes(gold: tuple[np.ndarray, np.ndarray], hyp: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same for numbered labels: each side is (numbers of all rows, how many each row has)."""
    (left, n), (right, m) = gold, hyp
    at_n, at_m = np.cumsum(n) - n, np.cumsum(m) - m
    out = [None] * len(n)
    for pick, high, wide in _batches(n, m):
        a, b = np.full((len(pick), high), -1, np.int64), np.full((len(pick), wide), -2, np.int64)
        for into, flat, at, size in ((a, left, at_n[pick], n[pick]), (b, right, at_m[pick], m[pick])):
            row = np.repeat(np.arange(len(pick)), size)
            col = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            into[row, col] = flat[at[row] + col]
        score = np.zeros((high + 1, len(pick), wide + 1), np.int32)
        score[0] = GAP * np.arange(wide + 1)
        ramp = np.arange(wide + 1, dtype=np.int32)
        for i in range(1, high + 1):
            gain = np.where(a[:, i - 1 : i] == b, MATCH, MISMATCH)
            row = score[i]
            row[:, 0] = GAP * i
            np.maximum(score[i - 1, :, :-1] + gain, score[i - 1, :, 1:] + GAP, out=row[:, 1:])
            row += ramp  # a gap costs the same everywhere, so the in-row recurrence is a running maximum
            np.maximum.accumulate(row, axis=1, out=row)
            row -= ramp
        rows = np.arange(len(pick))

        def move(i, j, score=score, a=a, b=b, rows=rows):
            up, left = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
            here = score[i, rows, j]
            equal = (a[rows, up] == b[rows, left]) if a.shape[1] and b.shape[1] else np.zeros(len(rows), bool)
            diagonal = (i > 0) & (j > 0) & (here == score[up, rows, left] + np.where(equal, MATCH, MISMATCH))
            return np.where(diagonal, 0, np.where((i > 0) & (here == score[up, rows, j] + GAP), 1, 2))

        for k, steps in zip(pick, _trace(n[pick], m[pick], move), strict=True):
            out[k] = steps
    return out


def align_time_batch(gold: list[list[dict]], hyp: list[list[dict]], weight: float = 2.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """As above, at least cost: label penalty (0 equal, half for an equal class, else 2) plus ``weight`` times the seconds both edges are off, to the millionth; indels cost 1.

    Elements are dicts with label, cls, start_us and end_us.
    """
    element = pa.struct([("label", pa.string()), ("cls", pa.string()), ("start_us", pa.int64()), ("end_us", pa.int64())])
    return align_timed(*timed_codes(*(pa.array(side, pa.list_(element)) for side in (gold, hyp))), weight)


def timed_codes(*columns: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(label's number, class's number, start, end of all elements: four rows; how many each row has) of each list column of structs with label, cls, start_us and end_us. Null rows are empty."""
    flat = [c.flatten() for c in columns]
    sizes = [c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
    cuts = np.cumsum([len(f) for f in flat])[:-1]
    numbers = []
    for name in ("label", "cls"):
        made = pa.chunked_array([f.field(name).cast(pa.string()) for f in flat], pa.string()).combine_chunks().dictionary_encode(null_encoding="encode")
        made = made.combine_chunks() if isinstance(made, pa.ChunkedArray) else made
        numbers.append(np.split(made.indices.to_numpy(zero_copy_only=False).astype(np.int64), cuts))
    times = [[f.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for f in flat] for name in ("start_us", "end_us")]
    return [(np.stack([x[k] for x in (*numbers, *times)]), n) for k, n in enumerate(sizes)]


def align_timed(gold: tuple[np.ndarray, np.ndarray], hyp: tuple[np.ndarray, np.ndarray], weight: float = 2.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same for numbered labels and classes, as ``timed_codes`` gives them."""
    (left, n), (right, m) = gold, hyp
    at_n, at_m = np.cumsum(n) - n, np.cumsum(m) - m
    out = [None] * len(n)
    for pick, high, wide in _batches(n, m, share=16):
        a, b = np.zeros((4, high, len(pick)), np.int64), np.zeros((4, wide, len(pick)), np.int64)
        for into, flat, at, size in ((a, left, at_n[pick], n[pick]), (b, right, at_m[pick], m[pick])):
            column = np.repeat(np.arange(len(pick)), size)
            row = np.arange(len(column)) - np.repeat(np.cumsum(size) - size, size)
            into[:, row, column] = flat[:, at[column] + row]
        off = np.abs(a[2, :, None, :] - b[2, None, :, :])
        off += np.abs(a[3, :, None, :] - b[3, None, :, :])
        pair = np.rint(weight * off).astype(np.int64)
        pair += np.where(a[0, :, None, :] == b[0, None, :, :], LABEL_COST, np.where(a[1, :, None, :] == b[1, None, :, :], CLASS_COST, SWAP_COST))
        cost = np.zeros((high + 1, wide + 1, len(pick)), np.int64)
        cost[:, 0], cost[0, :] = (np.arange(high + 1) * INDEL_COST)[:, None], (np.arange(wide + 1) * INDEL_COST)[:, None]
        for d in range(2, high + wide + 1):  # anti-diagonals of the whole batch
            i = np.arange(max(1, d - wide), min(high, d - 1) + 1)
            j = d - i
            cost[i, j] = np.minimum(np.minimum(cost[i - 1, j - 1] + pair[i - 1, j - 1], cost[i - 1, j] + INDEL_COST), cost[i, j - 1] + INDEL_COST)
        rows = np.arange(len(pick))

        def move(i, j, cost=cost, pair=pair, rows=rows):
            up, left = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
            here = cost[i, j, rows]
            step = pair[up, left, rows] if pair.shape[0] and pair.shape[1] else np.zeros(len(rows), np.int64)
            diagonal = (i > 0) & (j > 0) & (here == cost[up, left, rows] + step)
            return np.where(diagonal, 0, np.where((i > 0) & (here == cost[up, j, rows] + INDEL_COST), 1, 2))

        for k, steps in zip(pick, _trace(n[pick], m[pick], move), strict=True):
            out[k] = steps
    return out


def _with_steps(pairs: DataFrame, work) -> DataFrame:
    schema = StructType([*pairs.schema.fields, StructField("steps", STEPS)])
    element = pa.struct([("g", pa.int32()), ("h", pa.int32())])

    def run(batches):
        for batch in batches:
            steps = work(batch)
            sizes = [len(g) for g, _ in steps]
            g, h = (np.concatenate([s[k] for s in steps] or [[]]).astype(np.int32) for k in (0, 1))
            flat = pa.StructArray.from_arrays([pa.array(g, mask=g < 0), pa.array(h, mask=h < 0)], fields=list(element))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "steps"])

    return pairs.mapInArrow(run, schema)


def by_label(batch: pa.RecordBatch, gold: str = "gold", hyp: str = "hyp") -> list[tuple[np.ndarray, np.ndarray]]:
    """Steps of a batch's pairs as ``align_labels`` finds them."""
    return align_codes(*label_codes(batch.column(gold), batch.column(hyp)))


def by_time(batch: pa.RecordBatch, gold: str = "gold", hyp: str = "hyp", weight: float = 2.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Steps of a batch's pairs as ``align_times`` finds them."""
    return align_timed(*timed_codes(batch.column(gold), batch.column(hyp)), weight)


def align_labels(pairs: DataFrame, gold: str = "gold", hyp: str = "hyp") -> DataFrame:
    """Adds steps array<struct<g int, h int>> (0-based; null: an indel) to pairs with two arrays of labels, or of structs that have one. Null arrays count as empty. No shuffle."""
    return _with_steps(pairs, lambda b: by_label(b, gold, hyp))


def align_times(pairs: DataFrame, gold: str = "gold", hyp: str = "hyp", weight: float = 2.0) -> DataFrame:
    """As align_labels, by label, class and time, over arrays of structs with label, cls, start_us and end_us, other fields being left alone."""
    return _with_steps(pairs, lambda b: by_time(b, gold, hyp, weight))
