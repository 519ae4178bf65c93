"""Shards of nearly equal bytes by a k-d tree over metadata, in DataFrame functions only.

A node of the tree is cut along the metadata dimension in which its rows are widest, at a weighted median of their bytes, and its halves go on until each is one
shard. Medians are exact to the row: histograms of a node's rows narrow in on the row whose middle byte the cut falls on, first by its coordinate, then, among rows
that share it, by hashes of text and metadata. No table is ever sorted, and no node is gathered in one place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import discard, staged

#: Bytes a row counts besides its text; bins of a histogram; bits of a hash; rows ranked in one window; the largest coordinate either side of 0.
ROW_BYTES, BINS, HASH_BITS, RANKED, FARTHEST = 16, 4096, 60, 65536, 1 << 61
DIMENSIONS = ("doc_id", "source", "lang", "n_chars")


def hash60(text: Column) -> Column:
    """The leading 60 bits of a text's MD5, as a long."""
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


@dataclass
class Node:
    """Rows still together: they end in ``leaves`` shards from ``first`` on. ``pins`` and what follows say how far the search for its cut has come."""

    first: int
    leaves: int
    weight: int
    dim: int = 0
    pins: list[int] = field(default_factory=list)
    low: int = 0
    step: int = 1
    before: int = 0
    cut: tuple[int, ...] | None = None
    left: int = 0

    @property
    def open(self) -> bool:
        return self.leaves > 1 and self.weight > 0 and self.cut is None

    @property
    def target(self) -> int:
        """A row goes left if twice the bytes up to its middle are at most this."""
        return 2 * self.weight * (self.leaves // 2) // self.leaves

    def narrow(self, low: int, high: int) -> None:
        self.low, self.step = low, -(-(high - low + 1) // BINS)

    def close(self, value: int, inclusive: bool) -> None:
        """The cut lies at the rows that share ``pins`` and ``value``: after them or before."""
        end = (1 << 62) if inclusive else -(1 << 62)
        self.cut = (*self.pins, value, *[end] * (3 - len(self.pins)))

    def found(self, before: int, weight: int, rows: int, low: int, high: int) -> None:
        """The bin that holds the cut: go on inside it, among rows that differ in it not at all by their next key, or end at its only row."""
        self.before = before
        last = len(self.pins) == 3
        if rows == 1 or low == high and last:
            inclusive = 2 * before + weight <= self.target
            self.left = before + weight * inclusive
            self.close(low, inclusive)
        elif low == high:
            self.pins.append(low)
            self.narrow(0, (1 << HASH_BITS) - 1)
        else:
            self.narrow(low, high)

    def halves(self) -> list[Node]:
        half = self.leaves // 2
        if self.leaves == 1:
            return [self]
        if self.cut is None:  # no rows
            return [Node(self.first, half, 0), Node(self.first + half, self.leaves - half, 0)]
        return [Node(self.first, half, self.left), Node(self.first + half, self.leaves - half, self.weight - self.left)]


def _per_node(values: list[int]) -> Column:
    """The element of ``values`` that belongs to a row's node: one constant, whatever the number of nodes."""
    return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), F.col("node"))


def _find_cuts(rows: DataFrame, nodes: list[Node], dims: list[Column]) -> None:
    """Sets the cuts of all open nodes. Every round reads the rows once and brings back one bin a node."""
    while any(n.open for n in nodes):
        live = [n if n.open else None for n in nodes]
        at = _per_node([len(n.pins) if n else -1 for n in live])
        keys = F.array(F.get(F.array(*dims), _per_node([n.dim for n in nodes]).cast("int")), F.col("by_text"), F.col("by_row"), F.col("salt"))
        value = F.get(keys, at.cast("int"))
        pins = [_per_node([n.pins[k] if n and len(n.pins) > k else 0 for n in live]) for k in range(3)]
        inside = [(at <= k) | (F.get(keys, F.lit(k)) == p) for k, p in enumerate(pins)]
        low, step = _per_node([n.low if n else 0 for n in live]), _per_node([n.step if n else 1 for n in live])
        some = rows.where(at >= 0).where(inside[0] & inside[1] & inside[2]).select("node", "size", value.alias("v"), low.alias("low"), step.alias("step"))
        some = some.where((F.col("v") >= F.col("low")) & (F.col("v") < F.col("low") + F.col("step") * BINS)).withColumn("bin", F.expr("(v - low) div step"))
        bins = some.groupBy("node", "bin").agg(F.sum("size").alias("w"), F.count("*").alias("rows"), F.min("v").alias("least"), F.max("v").alias("most"))
        held = bins.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("bin", "w", "rows", "least", "most"))).alias("bins"))  # at most BINS a node

        def passed(b: Column, goal: Column) -> Column:
            return 2 * b > goal

        goal, before = _per_node([n.target if n else 0 for n in live]), _per_node([n.before if n else 0 for n in live])
        start = F.struct(before.alias("before"), F.lit(-1).cast("int").alias("at"), F.lit(0).cast("int").alias("seen"))

        def step_on(acc: Column, b: Column) -> Column:
            after = acc["before"] + b["w"]
            done = acc["at"] >= 0
            here = ~done & passed(after, F.col("goal"))
            return F.struct(
                F.when(done | here, acc["before"]).otherwise(after).alias("before"),
                F.when(here, acc["seen"]).otherwise(acc["at"]).alias("at"),
                (acc["seen"] + 1).alias("seen"),
            )

        walked = held.withColumn("goal", goal).withColumn("walk", F.aggregate("bins", start, step_on))
        hit = F.get("bins", F.col("walk")["at"])
        for r in walked.select("node", F.col("walk")["before"].alias("before"), hit.alias("hit")).collect():  # a row a node
            h = r["hit"]
            nodes[r["node"]].found(r["before"], h["w"], h["rows"], h["least"], h["most"])


def assign(docs: DataFrame, shards: int = 0, target_bytes: int = 0, dims: tuple[str, ...] = DIMENSIONS, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Rows of ``docs`` -> the columns ``keep``, size long (UTF-8 bytes of the text and ROW_BYTES), shard int, slot long (gapless from 0 in each shard).

    ``shards`` says how many; where it is 0, as many as leaves of at most ``target_bytes`` need. Bytes are as equal as whole rows allow: a cut misses its place by half a row at most.
    ``dims`` are whole numbers, compared by value (beyond 2^61 as that), or strings, compared by hash, so that each value lies together; a dimension's null counts as its least value. A node's
    width in a dimension is measured against the table's; of equally wide ones the first in ``dims`` is cut. Rows with one coordinate go on by the hash of their text, so that equal
    texts stay together but for the one group that a cut goes through, then by that of their metadata; rows equal in all of it are interchangeable. Null text: no bytes.
    Empty table: no rows. Fewer rows than shards: some shards are empty. Columns besides these are ignored, and may have any names.

    Only keys and sizes are written, once a level of the tree (log2 of the number of shards); put ``text`` into ``keep`` to have texts go with their rows. The driver
    holds the tree: a few numbers a shard.
    """
    strings = [isinstance(docs.schema[d].dataType, StringType) for d in dims]
    place = lambda d, s: hash60(F.col(d)) if s else F.greatest(F.least(F.col(d).cast("bigint"), F.lit(FARTHEST)), F.lit(-FARTHEST))
    named = F.concat(*[F.concat(F.coalesce(F.col(d).cast("string"), F.lit("-")), F.lit(",")) for d in dims])
    rows = docs.select(
        F.struct(*keep).alias("row"),
        (text_bytes(F.col(text)) + ROW_BYTES).alias("size"),
        *[F.when(F.col(d).isNotNull(), place(d, s)).alias(f"dim{i}") for i, (d, s) in enumerate(zip(dims, strings, strict=True))],
        F.coalesce(hash60(F.col(text)), F.lit(0)).alias("by_text"),
        hash60(named).alias("by_row"),
        F.lit(0).alias("node"),
    ).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << HASH_BITS) - 1))
    rows, path = staged(rows, "kd")  # fixes the salt
    names = [f"dim{i}" for i in range(len(dims))]
    whole = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), *[f(d).alias(f"{d}{k}") for d in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    shards = shards or max(1, math.ceil(whole["bytes"] / max(1, target_bytes)))
    least = [whole[f"{d}lo"] or 0 for d in names]
    spans = [float((whole[f"{d}hi"] or 0) - lo) for d, lo in zip(names, least, strict=True)]
    columns = [F.coalesce(F.col(d), F.lit(lo)) for d, lo in zip(names, least, strict=True)]
    nodes = [Node(0, shards, whole["bytes"])]
    while any(n.leaves > 1 for n in nodes):
        extents = rows.groupBy("node").agg(*[f(c).alias(f"{d}{k}") for d, c in zip(names, columns, strict=True) for k, f in (("lo", F.min), ("hi", F.max))])
        for r in extents.collect():  # a row a node
            n = nodes[r["node"]]
            if n.open:
                width = [float(r[f"{d}hi"] - r[f"{d}lo"]) / span if span else 0.0 for d, span in zip(names, spans, strict=True)]
                n.dim = width.index(max(width))
                n.narrow(r[f"{names[n.dim]}lo"], r[f"{names[n.dim]}hi"])
        _find_cuts(rows, nodes, columns)
        after, left_at = [], []
        for n in nodes:
            left_at.append(len(after))
            after += n.halves()
        key = [F.get(F.array(*columns), _per_node([n.dim for n in nodes]).cast("int")), F.col("by_text"), F.col("by_row"), F.col("salt")]
        cut = [_per_node([n.cut[k] if n.cut else 1 << 62 for n in nodes]) for k in range(4)]
        left = key[3] <= cut[3]
        for k in (2, 1, 0):
            left = (key[k] < cut[k]) | ((key[k] == cut[k]) & left)
        moved, new_path = staged(rows.withColumn("node", (_per_node(left_at) + F.when(left, 0).otherwise(1)).cast("int")), "kd")
        discard(rows.sparkSession, path)
        rows, path, nodes = moved, new_path, after
    # slots: ranks within ranges of the row hash, shifted by the rows of the ranges before
    ranges = max(1, math.ceil(whole["n"] / shards / RANKED))
    rows = rows.withColumns({"shard": _per_node([n.first for n in nodes]).cast("int"), "range": F.expr(f"by_row div {-(-(1 << HASH_BITS) // ranges)}")})
    counts = rows.groupBy("shard", "range").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "range", F.coalesce(upto, F.lit(0)).alias("upto"))
    rank = F.row_number().over(Window.partitionBy("shard", "range").orderBy("by_row", "by_text", "salt")) - 1
    slots = rows.withColumn("rank", rank).join(counts, ["shard", "range"])
    return slots.select("row.*", "size", "shard", (F.col("rank") + F.col("upto")).cast("bigint").alias("slot"))
