"""SimHash near-dedup with bit-sliced comparison.

Fingerprints that differ in at most RADIUS = 2 of 64 bits agree in at least two of four 16-bit blocks, so each of the six pairs of blocks is a table of exact
candidates. Within a bucket the fingerprints stand vertically, as 64 bit planes; a query's distances to 64 of them at a time are counted by
carry-save bitwise counters, and words in which every distance has passed the radius are abandoned early. A bucket yields a spanning forest of its
links, never all pairs; buckets of more than CELL fingerprints are cut into sub-blocks whose pairs are separate tasks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_caches, materialize

RADIUS, SEED, CELL, SMALL, QUERIES_AT_ONCE, TASKS_AT_ONCE = 2, 42, 4096, 128, 64, 1 << 18
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """A bit is 1 if set in over half the shingles' hashes; fewer words than ``words``: one shingle; none: zero."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    digest, count, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), max(1, len(w) - words + 1)
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)
    for part in np.split(hashes, range(1 << 16, n, 1 << 16)):
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, fp (the 64 bits as a signed number), and the columns ``keep`` of long numbers. Null text counts as empty."""

    def run(batches):
        drop_caches()
        for batch in batches:
            made = np.array([fingerprint(t, words) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64)), *[batch.column(c) for c in keep]], ["doc_id", "fp", *keep])

    return docs.select("doc_id", "text", *keep).mapInArrow(run, ", ".join(f"{c} bigint" for c in ("doc_id", "fp", *keep)))


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: [b, w] holds bit b of fingerprints 64 w to 64 w + 63."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near(at, masks, live, shrink):
    """Which of the words' 64 fingerprints each are within RADIUS, as bits.

    ``at(b)`` gives plane b of the words compared, ``masks(b)`` their queries' bit b as no or all ones, ``live`` the bits that matter.
    ``shrink(keep)`` is called now and then with the words not yet abandoned, and returns ``live`` for them, or None to go on unshrunk.
    """
    ones, twos, over = np.zeros_like(live), np.zeros_like(live), np.zeros_like(live)
    for b in range(64):
        x = at(b) ^ masks(b)
        carry = ones & x
        ones ^= x
        over |= twos & carry
        twos ^= carry
        if b % 8 == 7:
            alive = live & ~(over | ones & twos)
            if not alive.any():
                return None
            smaller = shrink(alive)
            if smaller is not None:
                keep, live = smaller
                ones, twos, over = ones[..., keep], twos[..., keep], over[..., keep]
    return live & ~(over | ones & twos)


def small_links(fps: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside many small groups at once (``group`` ascends): the pairs, as two arrays of positions."""
    p, n = planes(fps), len(fps)
    starts = np.searchsorted(group, group, "left")
    ends = np.searchsorted(group, group, "right")
    q0 = np.arange(n)
    first, last = (q0 + 1) // 64, (ends - 1) // 64
    counts = np.where(q0 + 1 < ends, last - first + 1, 0)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    bounds = np.searchsorted(np.cumsum(counts), np.arange(TASKS_AT_ONCE, counts.sum() + TASKS_AT_ONCE, TASKS_AT_ONCE))
    del starts
    for chunk in np.split(q0, np.unique(bounds)):
        c = counts[chunk]
        q = np.repeat(chunk, c)
        if not len(q):
            continue
        w = first[q] + np.arange(len(q)) - np.repeat(np.cumsum(c) - c, c)
        low = np.maximum(q + 1 - 64 * w, 0).astype(np.uint64)
        high = np.minimum(ends[q] - 64 * w, 64).astype(np.uint64)
        live = (ALL << low) & (ALL >> (np.uint64(64) - high))
        state = {"q": q, "w": w, "live": live}

        def shrink(alive, state=state):
            keep = alive != 0
            if keep.sum() > 0.7 * len(keep):
                return None
            for k in state:
                state[k] = state[k][keep]
            return keep, state["live"]

        hits = near(lambda b, s=state: p[b, s["w"]], lambda b, s=state: np.uint64(0) - (fps[s["q"]] >> np.uint64(b) & np.uint64(1)), live, shrink)
        if hits is not None:
            some = np.flatnonzero(hits)
            bit = (hits[some, None] >> BITS & np.uint64(1)).astype(bool)
            row, col = np.nonzero(bit)
            found.append((state["q"][some[row]], state["w"][some[row]] * 64 + col))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component in place of the pairs (a, b) of positions below n."""
    label = np.arange(n)
    while True:
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == old).all():
            moved = np.flatnonzero(label != np.arange(n))
            return moved, label[moved]


def large_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of one large group, breadth first: every fingerprint is a query once, against those not reached yet."""
    p, n = planes(fps), len(fps)
    waiting = np.full(p.shape[1], ALL)
    if n % 64:
        waiting[-1] = ALL >> np.uint64(64 - n % 64)
    a, b = [], []
    while True:
        left = np.flatnonzero(waiting)
        if not len(left):
            return np.array(a, np.int64), np.array(b, np.int64)
        word = int(waiting[left[0]])
        seed = int(left[0]) * 64 + (word & -word).bit_length() - 1
        waiting[seed // 64] &= ~(np.uint64(1) << np.uint64(seed % 64))
        frontier = [seed]
        while frontier:
            queries, frontier = frontier[:QUERIES_AT_ONCE], frontier[QUERIES_AT_ONCE:]
            words = np.flatnonzero(waiting)
            if not len(words):
                frontier = []
                break
            state = {"w": words}
            mask = np.uint64(0) - (fps[queries][:, None] >> BITS & np.uint64(1))
            live = np.broadcast_to(waiting[words], (len(queries), len(words))).copy()

            def shrink(alive, state=state, queries=queries):
                keep = alive.any(axis=0)
                if keep.sum() > 0.7 * len(keep):
                    return None
                state["w"] = state["w"][keep]
                return keep, np.broadcast_to(waiting[state["w"]], (len(queries), len(state["w"]))).copy()

            hits = near(lambda i, s=state: p[i, s["w"]][None, :], lambda i, m=mask: m[:, i][:, None], live, shrink)
            if hits is None:
                continue
            for k, query in enumerate(queries):
                new = hits[k] & waiting[state["w"]]
                some = np.flatnonzero(new)
                if len(some):
                    waiting[state["w"]] &= ~new
                    row, col = np.nonzero((new[some, None] >> BITS & np.uint64(1)).astype(bool))
                    reached = (state["w"][some[row]] * 64 + col).tolist()
                    a += [query] * len(reached)
                    b += reached
                    frontier += reached


def bucket_links(fps: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each group; ``group`` ascends."""
    fps = fps.view(np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, len(group)))
    a, b = [], []
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        x, y = large_links(fps[s : s + n])
        a.append(x + s)
        b.append(y + s)
    few = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    if len(few):
        x, y = forest(len(few), *small_links(fps[few], group[few]))
        a.append(few[x])
        b.append(few[y])
    return np.concatenate(a), np.concatenate(b)


def links(distinct: DataFrame, cell: int = CELL) -> DataFrame:
    """``distinct(fp)`` -> edges (a, b) that connect exactly the fingerprints connected by distances <= RADIUS."""
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [F.shiftleft(F.lit(t).cast("long"), 32) + F.shiftleft(block[i], 16) + block[j] for t, (i, j) in enumerate(combinations(range(4), 2))]
    banded = distinct.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    held = banded.join(sizes, "bucket").withColumn("m", F.ceil(F.col("n") / cell).cast("int"))
    held = held.withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    cells = held.select("bucket", "fp", "sub", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"))
    cells = cells.select(F.xxhash64("bucket", F.least("sub", "other"), F.greatest("sub", "other")).alias("cell"), "fp", "bucket")
    cells = cells.repartition("cell").sortWithinPartitions("cell", "bucket", "fp")

    def run(batches):
        drop_caches()
        kept = np.zeros((2, 0), np.int64)

        def linked(rows):
            x, y = bucket_links(np.ascontiguousarray(rows[1]), rows[0])
            return pa.RecordBatch.from_arrays([pa.array(rows[1][x]), pa.array(rows[1][y])], ["a", "b"])

        for batch in batches:
            rows = np.concatenate([kept, np.array([batch.column("cell").to_numpy(), batch.column("fp").to_numpy()])], axis=1)
            if not rows.shape[1]:
                continue
            cut = np.searchsorted(rows[0], rows[0][-1], "left")  # the last cell may go on in the next batch
            kept = rows[:, cut:]
            if cut:
                yield linked(rows[:, :cut])
        if kept.shape[1]:
            yield linked(kept)

    return cells.mapInArrow(run, "a bigint, b bigint")


def near_dedup(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, fp, component_id (the smallest doc_id reachable over links of at most RADIUS bits, itself included).

    Null text is empty; texts without words have fingerprint 0 and are linked like any other. Repeated doc_ids are rows of their own; a null doc_id is a row
    whose component_id is null only if no other id is in its component. No rows: no rows. Other columns are ignored. Equal fingerprints are one node of the
    graph, so a group of exact copies costs one comparison however large it is.
    """
    prints = materialize(fingerprints(docs, words), "fingerprints")
    grouped = fp_components(prints)
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    of = materialize(grouped.join(smallest, "component").select("fp", "component_id"), "components")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def fp_components(prints: DataFrame) -> DataFrame:
    """``prints(doc_id, fp)`` -> a row for each fp: fp, first (its smallest doc_id), component (the smallest fp reachable over links)."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(links(distinct)).withColumnRenamed("node", "fp")
    return distinct.join(found, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))


def one_of_each(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row of each component of ``docs(doc_id, text, ...)``: that with the smallest doc_id, nulls last, then the smallest hash of its columns. All columns stay."""
    parts = [x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]  # a hash skips nulls
    key = ["_cadenza_row", "_cadenza_again"]
    keyed = docs.withColumns({key[0]: F.xxhash64(*parts), key[1]: F.xxhash64(F.lit(SEED), *parts)})
    prints = materialize(fingerprints(keyed, words, tuple(key)), "fingerprints")
    of = materialize(fp_components(prints).select("fp", "component"), "components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *key)
    chosen = prints.join(of, "fp").groupBy("component").agg(F.min(order).alias("m")).select(*[F.col("m")[k].alias(k) for k in key])
    return keyed.join(chosen, key, "left_semi").dropDuplicates(key).select(*[F.col(f"`{c}`") for c in docs.columns])
