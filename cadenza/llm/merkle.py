"""Merkle manifest of a dataset: a tree over each group's documents in order of doc_id, and one over the groups' roots.

Where a document's leaf lies in its group's tree is its rank, and ranks come from bitmaps: every 64 ids of a group are a word, empty words are left out, and directories
of counts over words, blocks of 2^12, 2^28 and 2^44 ids say how many leaves come before. Nothing is sorted. Leaves then go into slot arrays keyed by group and place,
of 3^7 slots each, so that a task reduces seven levels of a tree at once and no group's tree lies in one place.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Nodes a parent has, levels reduced by a slot array, bits of an id within a word, a container and the directories above.
FAN, LEVELS, WORD, CONTAINER, HIGHER = 3, 7, 6, 12, (28, 44)
SLOTS = FAN**LEVELS
#: Copies of one leaf that one row stands for.
CHUNK = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(fields: list[Column]) -> Column:
    """Each field as ``-`` if null, else its UTF-8 bytes' number, ``:`` and itself, all in one."""
    texts = [f.cast("string") for f in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def leaves(docs: DataFrame, altered: Column | None = None, fields: tuple[str, ...] = FIELDS, id: str = "doc_id", group: str = "source") -> DataFrame:
    """id bigint, named bool (the id isn't null), key string (orders groups, null first), leaf binary, forged binary (of the ``altered`` text; null where it's no other).

    Equal rows become one row with their number as ``copies``.
    """
    own = F.sha2(encoded([F.col(f) for f in fields]), 256)
    other = F.sha2(encoded([altered if f == "text" else F.col(f) for f in fields]), 256) if altered is not None else F.lit(None).cast("string")
    forged = F.when(altered.isNotNull() & (altered != F.col("text")), other) if altered is not None else other
    key = F.coalesce(F.concat(F.lit("1"), F.col(group)), F.lit("0"))
    rows = docs.select(F.coalesce(F.col(id).cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.col(id).isNotNull().alias("named"), key.alias("key"), F.unhex(own).alias("leaf"), F.unhex(forged).alias("forged"))
    return rows.groupBy("id", "named", "key", "leaf", "forged").agg(F.count("*").alias("copies"))


def _before(rows: DataFrame, keys: list[str], order: str, count: str, name: str) -> DataFrame:
    """Adds ``name``: sum of ``count`` over the rows of ``keys`` with a smaller ``order``."""
    upto = F.sum(count).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, F.coalesce(upto, F.lit(0)))


def bitmaps(rows: DataFrame) -> DataFrame:
    """``rows(key, id, copies)`` -> one row per key and container of 2^12 ids: key, high, at array<int> (places of words that aren't empty), words array<bigint>,
    before array<bigint> (leaves before each word in the whole group), more array<array<struct<bit, n>>> (leaves beyond one of ids in the word that have several).

    Words are partial on every task and merged by OR; directories are sums of the level below, over at most 65,536 rows of one directory at a time.
    """
    ids = rows.groupBy("key", "id").agg(F.sum("copies").alias("n"))
    bit = F.col("id").bitwiseAND((1 << WORD) - 1).cast("int")
    extra = F.when(F.col("n") > 1, F.struct(bit.alias("bit"), (F.col("n") - 1).alias("n")))
    words = ids.groupBy("key", F.shiftright("id", WORD).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(id & {(1 << WORD) - 1} as int))")).alias("word"), F.sum("n").alias("n"), F.collect_list(extra).alias("more"))
    place = F.col("w").bitwiseAND((1 << (CONTAINER - WORD)) - 1).cast("int")
    word = F.struct(place.alias("at"), "word", "n", "more")
    held = words.groupBy("key", F.shiftright("w", CONTAINER - WORD).alias("high")).agg(F.array_sort(F.collect_list(word)).alias("ws"), F.sum("n").alias("n"))
    held = materialize(held, "bitmaps")
    # directories from the top: leaves before each block of 2^44, of 2^28 within it, and each container within that
    level = held.withColumns({"b0": F.shiftright("high", HIGHER[0] - CONTAINER), "b1": F.shiftright("high", HIGHER[1] - CONTAINER)})
    top = _before(level.groupBy("key", "b1").agg(F.sum("n").alias("n")), ["key"], "b1", "n", "p1").select("key", "b1", "p1")
    middle = _before(level.groupBy("key", "b1", "b0").agg(F.sum("n").alias("n")), ["key", "b1"], "b0", "n", "p0").select("key", "b1", "b0", "p0")
    low = _before(level, ["key", "b1", "b0"], "high", "n", "p")
    sums = low.join(middle, ["key", "b1", "b0"]).join(top, ["key", "b1"]).withColumn("p", F.col("p") + F.col("p0") + F.col("p1"))
    count = F.transform("ws", lambda w: w["n"])
    before = F.transform(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: F.col("p") + F.aggregate(F.slice(count, 1, i), F.lit(0).cast("bigint"), lambda a, b: a + b))
    return sums.select("key", "high", F.col("ws")["at"].alias("at"), F.col("ws")["word"].alias("words"), before.alias("before"), F.col("ws")["more"].alias("more"))


def rank(at: Column, words: Column, before: Column, more: Column, id: Column) -> Column:
    """Leaves of the group before those of ``id``, which is in the bitmap."""
    bit = id.bitwiseAND((1 << WORD) - 1).cast("int")
    k = F.array_position(at, F.shiftright(id, WORD).bitwiseAND((1 << (CONTAINER - WORD)) - 1).cast("int")).cast("int") - 1
    below = F.bit_count(F.get(words, k).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), bit))))
    several = F.aggregate(F.filter(F.get(more, k), lambda m: m["bit"] < bit), F.lit(0).cast("bigint"), lambda a, m: a + m["n"])
    return F.get(before, k) + below + several


def ranked(rows: DataFrame) -> DataFrame:
    """``leaves`` -> a row a leaf with ``pos``, its place in its group: by id, null first, then by leaf. Copies of a row lie one after another."""
    maps = bitmaps(rows)
    here = rows.withColumn("high", F.shiftright("id", CONTAINER)).join(maps, ["key", "high"])
    bit = F.col("id").bitwiseAND((1 << WORD) - 1).cast("int")
    k = F.array_position("at", F.shiftright("id", WORD).bitwiseAND((1 << (CONTAINER - WORD)) - 1).cast("int")).cast("int") - 1
    here = here.withColumns({"pos": rank(F.col("at"), F.col("words"), F.col("before"), F.col("more"), F.col("id")), "several": F.exists(F.get("more", k), lambda m: m["bit"] == bit)})
    here = here.select("id", "named", "key", "leaf", "forged", "copies", "pos", "several")
    # ids with several leaves go on by the leaf: ranks within ranges of its leading bytes, shifted by the ranges before
    many = here.where("several").withColumn("range", F.concat(F.when(F.col("named"), "1").otherwise("0"), F.hex(F.substring("leaf", 1, 2))))
    ranges = _before(many.groupBy("key", "id", "range").agg(F.sum("copies").alias("n")), ["key", "id"], "range", "n", "upto").drop("n")
    many = _before(many, ["key", "id", "range"], "leaf", "copies", "inside").join(ranges, ["key", "id", "range"])
    many = many.withColumn("pos", F.col("pos") + F.col("upto") + F.col("inside"))
    # copies are told apart by their places only: chunks of them are spread before they become rows
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(CHUNK).cast("bigint")))
    chunks = many.withColumn("chunk", chunk).repartition("key", "id", "leaf", "chunk")
    each = F.explode(F.sequence(F.col("chunk"), F.least(F.col("chunk") + CHUNK, F.col("copies")) - 1))
    spread = chunks.withColumn("each", each).withColumn("pos", F.col("pos") + F.col("each"))
    columns = ["id", "named", "key", "leaf", "forged", "pos"]
    return here.where("not several").select(*columns).unionByName(spread.select(*columns))


def digest(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def reduce(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of each level, from ``nodes`` up."""
    made = [nodes]
    for _ in range(levels):
        made.append([digest(made[-1][k : k + FAN]) for k in range(0, len(made[-1]), FAN)])
    return made


def path(levels: list[list[bytes]], at: int) -> bytes:
    """From the node at ``at`` to the top: level by level its place in its run, how many siblings it has there, and they."""
    out = []
    for nodes in levels[:-1]:
        run, place = at - at % FAN, at % FAN
        others = [*nodes[run:at], *nodes[at + 1 : run + FAN]]
        out += [bytes((place, len(others))), *others]
        at //= FAN
    return b"".join(out)


def steps(way: bytes):
    """A path's levels: place, siblings."""
    at = 0
    while at < len(way):
        place, n = way[at], way[at + 1]
        yield place, [way[k : k + 32] for k in range(at + 2, at + 2 + 32 * n, 32)]
        at += 2 + 32 * n


def fold(leaf: bytes, way: bytes) -> bytes:
    """The root that ``leaf`` and the siblings of its path give."""
    for place, others in steps(way):
        leaf = digest([*others[:place], leaf, *others[place:]])
    return leaf


def proof(way: bytes) -> str:
    return hashlib.sha256("".join(o.hex() for _, others in steps(way) for o in others).encode()).hexdigest()


def height(n: Column, most: int = 41) -> Column:
    """Levels from ``n`` nodes to one."""
    return F.size(F.filter(F.array(*[F.lit(min(FAN**k, (1 << 63) - 1)) for k in range(most)]), lambda p: p < n))


def _slot_arrays(nodes: DataFrame, sizes: DataFrame, columns: list[str], done: int) -> DataFrame:
    """``nodes(key, pos, node, ...)`` -> key, block, levels (to reduce here), slots: the nodes of each SLOTS places with ``columns``."""
    slot = F.struct((F.col("pos") % SLOTS).cast("int").alias("slot"), *columns)
    held = nodes.groupBy("key", F.expr(f"pos div {SLOTS}").alias("block")).agg(F.collect_list(slot).alias("slots"))
    return held.join(sizes, "key").withColumn("levels", F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.col("height") - done)))


def _in_order(row, columns: tuple[str, ...]):
    """Slot arrays of one row, by slot."""
    items = row.values
    n = len(items)
    where = items.field("slot").to_pylist()
    out = {c: [None] * n for c in columns}
    for c in columns:
        for k, v in zip(where, items.field(c).to_pylist(), strict=True):
            out[c][k] = v
    return out


def _tops(blocks: DataFrame) -> DataFrame:
    """The node each slot array reduces to: key, pos, node."""

    def work(batches):
        for batch in batches:
            tops = [reduce(_in_order(row, ("node",))["node"], n)[-1][0] for row, n in zip(batch.column("slots"), batch.column("levels").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), pa.array(tops, pa.binary())], ["key", "pos", "node"])

    return blocks.select("key", "block", "levels", F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), s["node"].alias("node"))).alias("slots")).mapInArrow(work, "key string, pos bigint, node binary")


def _ways(blocks: DataFrame) -> DataFrame:
    """``blocks(key, block, levels, slots, way, top)`` -> key, pos, way (its path, the block's own behind it), top."""

    def work(batches):
        for batch in batches:
            keys, blocks, levels, ways, tops = (batch.column(c).to_pylist() for c in ("key", "block", "levels", "way", "top"))
            for i, row in enumerate(batch.column("slots")):
                made = reduce(_in_order(row, ("node",))["node"], levels[i])
                n = len(made[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i]] * n, pa.string()), pa.array([blocks[i] * SLOTS + k for k in range(n)], pa.int64()), pa.array([path(made, k) + ways[i] for k in range(n)], pa.binary()), pa.array([tops[i]] * n, pa.binary())],
                    ["key", "pos", "way", "top"],
                )

    return blocks.select("key", "block", "levels", F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), s["node"].alias("node"))).alias("slots"), "way", "top").mapInArrow(work, "key string, pos bigint, way binary, top binary")


class Tree:
    """Trees over ``nodes(key, pos, node, ...)``, one a key, whose places have no gaps; ``sizes(key, n)`` has how many. Slot arrays of every seventh level are written as they're made."""

    def __init__(self, nodes: DataFrame, sizes: DataFrame, columns: list[str]):
        sizes = materialize(sizes.select("key", height(F.col("n")).alias("height")), "heights")
        highest = sizes.agg(F.max("height")).first()[0] or 0
        self.rounds = [materialize(_slot_arrays(nodes, sizes, columns, 0), "slots")]
        for done in range(LEVELS, highest, LEVELS):
            self.rounds.append(materialize(_slot_arrays(_tops(self.rounds[-1].where(F.col("height") > done)), sizes.where(F.col("height") > done), ["node"], done), "slots"))

    def tops(self) -> DataFrame:
        """key, node: the node that remains of each tree."""
        parts = [_tops(blocks.where((F.col("height") <= (k + 1) * LEVELS) & ((F.col("height") > k * LEVELS) | F.lit(k == 0)))) for k, blocks in enumerate(self.rounds)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select("key", "node")

    def blocks(self, ends: DataFrame) -> DataFrame:
        """The lowest slot arrays with each block's path to the top and ``ends(key, way, top)`` of its key behind it."""
        above = None
        for k in range(len(self.rounds) - 1, -1, -1):
            blocks, last = self.rounds[k], F.col("height") <= (k + 1) * LEVELS
            here = blocks.where(last).join(ends, "key")
            if above is not None:
                here = here.unionByName(blocks.where(~last).join(above, ["key", "block"]).select(*here.columns))
            if k == 0:
                return here
            above = materialize(_ways(here).withColumnRenamed("pos", "block"), "ways")


def places(keys: DataFrame) -> DataFrame:
    """``keys(key)``, all different -> key, pos: places in byte order, counted within ranges and shifted by the ranges before."""
    parts = materialize(keys.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "keys")
    counts = _before(parts.groupBy("part").agg(F.count("*").alias("n")), [], "part", "n", "upto").select("part", "upto")
    inside = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return parts.withColumn("inside", inside).join(counts, "part").select("key", (F.col("inside") + F.col("upto")).alias("pos"))


def manifest(docs: DataFrame, altered: Column | None = None, fields: tuple[str, ...] = FIELDS, id: str = "doc_id", group: str = "source", proofs: bool = True) -> DataFrame:
    """Rows of ``docs`` -> id (named as it is), key, pos, leaf, subroot, root, proof (null unless ``proofs``), proof_sha256, folded_root, verified; digests in lowercase hex.

    A leaf is the SHA-256 of the row's ``fields``, encoded without ambiguity. In each ``group`` leaves go by id (null first; rows of one id by leaf), and while several nodes remain
    every three in a row become the digest of their hex; the one that remains is the subroot. Subroots go by group (null first, by UTF-8 bytes) and become the root likewise. ``proof``
    has the siblings on the way from leaf to root, in order, one after another; ``folded_root`` is what leaf and siblings give, the leaf made from the ``altered`` text where that is given
    and differs; ``verified`` says that it's the root. Equal rows have equal leaves at places of their own. An empty table gives no rows. Other columns are ignored.
    """
    rows = materialize(leaves(docs, altered, fields, id, group), "leaves")
    placed = ranked(rows).withColumnRenamed("leaf", "node")
    tree = Tree(placed, rows.groupBy("key").agg(F.sum("copies").alias("n")), ["id", "named", "node", "forged"])
    groups = materialize(tree.tops(), "subroots")
    over = groups.join(places(groups.select("key")), "key").select(F.lit("").alias("key"), "pos", "node", F.col("key").alias("group"))
    upper = Tree(over, over.groupBy("key").agg(F.count("*").alias("n")), ["node", "group"])
    root = upper.tops().first()
    root = root["node"] if root else b""
    ends = upper.blocks(docs.sparkSession.range(1).select(F.lit("").alias("key"), F.lit(b"").alias("way"), F.lit(root).alias("top")))

    def finish(batches):
        for batch in batches:
            for row, n, way in zip(batch.column("slots"), batch.column("levels").to_pylist(), batch.column("way").to_pylist(), strict=True):
                held = _in_order(row, ("node", "group"))
                made = reduce(held["node"], n)
                yield pa.RecordBatch.from_arrays([pa.array(held["group"], pa.string()), pa.array([path(made, k) + way for k in range(len(made[0]))], pa.binary()), pa.array(held["node"], pa.binary())], ["key", "way", "top"])

    ends = materialize(ends.select("slots", "levels", "way").mapInArrow(finish, "key string, way binary, top binary"), "ends")

    def fold_all(batches):
        for batch in batches:
            keys, ways, tops, levels, blocks = (batch.column(c).to_pylist() for c in ("key", "way", "top", "levels", "block"))
            for i, row in enumerate(batch.column("slots")):
                held = _in_order(row, ("id", "named", "node", "forged"))
                made = reduce(held["node"], levels[i])
                n = len(made[0])
                whole = [path(made, k) + ways[i] for k in range(n)]
                folded = [fold(f or leaf, w) for f, leaf, w in zip(held["forged"], held["node"], whole, strict=True)]
                columns = {
                    "id": pa.array([v if named else None for v, named in zip(held["id"], held["named"], strict=True)], pa.int64()), "key": pa.array([keys[i]] * n, pa.string()), "pos": pa.array([blocks[i] * SLOTS + k for k in range(n)], pa.int64()),
                    "leaf": pa.array([v.hex() for v in held["node"]]), "subroot": pa.array([tops[i].hex()] * n), "root": pa.array([root.hex()] * n), "proof": pa.array(["".join(o.hex() for _, others in steps(w) for o in others) if proofs else None for w in whole], pa.string()),
                    "proof_sha256": pa.array([proof(w) for w in whole]), "folded_root": pa.array([f.hex() for f in folded]), "verified": pa.array([f == root for f in folded]),
                }
                yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    kind = "id bigint, key string, pos bigint, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string, verified boolean"
    return tree.blocks(ends).select("key", "block", "levels", "slots", "way", "top").mapInArrow(fold_all, kind).withColumnRenamed("id", id)
