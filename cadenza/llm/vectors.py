"""Embedding near-dedup by random-hyperplane hashing, and nearest neighbours over randomly rotated one-bit codes.

Both take ``embedding`` as an array of numbers. Vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of
different lengths are never compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import components, materialize
from .simhash import forest

#: Near-dedup: expected vectors in a bucket, chance that hashing misses a pair just at the threshold, and that the comparison of its signs does; vectors of a hot
#: bucket's sub-block, rows compared at once; a table of hot buckets of more rows isn't broadcast.
BUCKET, MISS, SIGN_MISS, CELL, BLOCK, SEED, HOT_ROWS = 256, 1e-4, 1e-7, 4096, 512, 5, 100_000
#: Neighbours: the error bound's width in standard deviations, bits of a code at least, bytes of vectors in a shard, rows and queries compared at once.
WIDTH, CODE_BITS, SHARD_BYTES, SLICE_ROWS, QUERY_BLOCK = 3.0, 512, 48 << 20, 8192, 32


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of vectors that all have ``dim`` components, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest component below 1: exact, and no square of it overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def tables_for(n: int, threshold: float) -> tuple[int, int]:
    """Sign bits a table and how many tables: buckets of about BUCKET vectors by chance, a pair at ``threshold`` missed with probability MISS."""
    bits = min(24, max(4, math.ceil(math.log2(max(n, 2) / BUCKET))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - together))


def most_differing(signs: int, threshold: float) -> int:
    """So many of ``signs`` signs differ at most between vectors at ``threshold``, but for a chance of SIGN_MISS."""
    p, left, k = math.acos(threshold) / math.pi, 1.0, -1
    while left > SIGN_MISS and k < signs:
        k += 1
        left -= math.exp(math.lgamma(signs + 1) - math.lgamma(k + 1) - math.lgamma(signs - k + 1) + k * math.log(p) + (signs - k) * math.log1p(-p)) if p else 1.0
    return k


def words(packed: pa.Array) -> np.ndarray:
    """A binary column of equally long values as rows of 64-bit words."""
    size = len(packed[0].as_py())
    return np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), size).view(np.uint64)


def near_dedup(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> vec_id, n_links, component_id, kept.

    A link is a pair with cosine >= ``threshold`` in double precision; n_links counts other rows linked directly, component_id is the smallest vec_id reachable,
    itself included, kept says vec_id = component_id. Unusable vectors link with nothing. Equal vectors (by 128 bits of hash) are one node with a multiplicity, so
    they're linked with each other and cost one comparison. A repeated vec_id keeps all its rows; rows of one vec_id with different vectors are one node. A null vec_id
    keeps its row and has no links of its own. No rows: no rows. Other columns are ignored.

    Every node goes into one bucket a table, as its packed signs in all tables: a few bytes, no vector. A pair is a candidate in the first table where
    its codes agree, if not too many of all its signs differ. Only nodes with a candidate in a cell meet there once more with their vectors, for exact cosines. Buckets
    above CELL nodes are cut into sub-blocks whose pairs are separate cells, and each cell gives counts and a spanning forest, never all pairs.
    """
    rows = vectors.select("vec_id", "embedding").withColumn("usable", usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    hashes = {"h": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(SEED), "embedding")}
    good = rows.where("usable").withColumns(hashes)
    nodes = good.groupBy("h", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    nodes = materialize(nodes, "nodes")
    bits, tables = tables_for(nodes.count(), threshold)
    most, width = most_differing(bits * tables, threshold), -(-bits * tables // 64) * 64

    def code(batches):
        planes = {}
        for batch in batches:
            v, sizes = batch.column("embedding"), np.array(pa.compute.list_value_length(batch.column("embedding")))
            signs = np.zeros((len(sizes), width), bool)
            for dim in np.unique(sizes):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, int(dim)]).normal(size=(int(dim), bits * tables))
                at = np.flatnonzero(sizes == dim)
                signs[at, : bits * tables] = scaled(matrix(v.take(pa.array(at)), int(dim))) @ planes[dim] > 0
            codes = _codes(signs, bits, tables)
            offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * tables)
            lists = pa.ListArray.from_arrays(offsets, pa.array(codes.astype(np.int32).ravel()))
            packed = pa.array([p.tobytes() for p in np.packbits(signs, axis=1, bitorder="little")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("h"), pa.array(sizes.astype(np.int32)), packed, lists], ["node", "h", "dim", "signs", "codes"])

    coded = nodes.select("node", "h", "embedding").mapInArrow(code, "node bigint, h bigint, dim int, signs binary, codes array<int>")
    placed = materialize(coded, "codes").select("node", "h", "dim", "signs", F.posexplode("codes").alias("t", "code"))
    hot = materialize(placed.groupBy("t", "code", "dim").agg(F.count("*").alias("n")).where(F.col("n") > CELL), "hot")
    hot = F.broadcast(hot) if hot.count() <= HOT_ROWS else hot
    held = placed.join(hot, ["t", "code", "dim"], "left").withColumn("m", F.coalesce(F.ceil(F.col("n") / CELL), F.lit(1)).cast("int"))
    held = held.withColumn("sub", F.pmod(F.xxhash64("node", "h"), F.col("m")).cast("int"))
    cells = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    cells = cells.withColumns({"i": F.least("sub", "other"), "j": F.greatest("sub", "other")})
    cells = cells.select(F.xxhash64("t", "code", "dim", "i", "j").alias("cell"), "t", "dim", F.when(F.col("i") != F.col("j"), F.col("sub")).alias("sub"), "node", "h", "signs")
    order = ("cell", "t", "dim", "node", "h")
    cells = cells.repartition("cell").sortWithinPartitions(*order)
    pick = "cell bigint, t int, dim int, sub int, node bigint, h bigint, signs binary"
    some = cells.mapInArrow(lambda batches: _by_cell(batches, lambda rows: _candidates(rows, most, bits, tables)), pick)
    some = some.join(nodes.select("node", "h", "copies", "embedding"), ["node", "h"]).repartition("cell").sortWithinPartitions(*order)
    link = some.mapInArrow(lambda batches: _by_cell(batches, lambda rows: _linked(rows, threshold, bits, tables)), "a bigint, b bigint, n bigint")
    found = materialize(link, "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    joined = components(found.where("b is not null").select("a", "b"))
    of = nodes.select("h", "h2", "node", "copies").join(counts, "node", "left").join(joined, "node", "left")
    of = of.select("h", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = good.select("vec_id", "h", "h2").join(of, ["h", "h2"]).select("vec_id", "n_links", "component_id")
    apart = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(apart).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _codes(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    return signs[:, : bits * tables].reshape(len(signs), tables, bits) @ (1 << np.arange(bits))


def _by_cell(batches, work):
    """``work`` on tables of whole cells; rows come sorted by cell."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows])
        ids = rows.column("cell").to_numpy()
        if not len(ids):
            continue
        cut = int(np.searchsorted(ids, ids[-1], "left"))  # the last cell may go on in the next batch
        kept = rows.slice(cut)
        if cut:
            yield from work(rows.slice(0, cut).combine_chunks()).to_batches()
    if kept is not None and kept.num_rows:
        yield from work(kept.combine_chunks()).to_batches()


def _cells(rows: pa.Table):
    """(start, end, table, length of vectors, which rows may be compared with which or None) of each cell of at least two rows."""
    ids = np.array([rows.column(c).to_numpy() for c in ("cell", "t", "dim")])
    sub = rows.column("sub").to_numpy()  # null, as NaN, where all meet all
    starts = np.flatnonzero(np.concatenate(([True], (ids[:, 1:] != ids[:, :-1]).any(axis=0))))
    for s, e in zip(starts, np.append(starts[1:], len(sub)), strict=True):
        if e - s > 1:
            yield s, e, int(ids[1, s]), int(ids[2, s]), None if np.isnan(sub[s]) else sub[s:e]


def _signs(rows: pa.Table) -> np.ndarray:
    return words(rows.column("signs").chunk(0))


def _first_here(codes: np.ndarray, t: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether table ``t`` is the first in which rows i and j have one code."""
    good = codes[i, t] == codes[j, t]
    for a in range(0, len(i) if t else 0, 1 << 18):
        part = slice(a, a + (1 << 18))
        good[part] &= (codes[i[part], :t] != codes[j[part], :t]).all(axis=1)
    return good


def _pairs(n: int, sub, close):
    """Pairs (i, j), i < j, of ``n`` rows, block by block, for which ``close(from, to)``, a matrix for rows from ``from`` to ``to`` and all from ``from`` on, is true."""
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        near = close(a, b)
        if sub is not None:  # a pair of sub-blocks: what lies within one is another cell's
            near &= sub[a:b, None] != sub[None, a:]
        i, j = np.nonzero(near)
        keep = j > i
        yield i[keep] + a, j[keep] + a


def _candidates(rows: pa.Table, most: int, bits: int, tables: int) -> pa.Table:
    """The rows that have a candidate in their cell."""
    signs, keep = _signs(rows), np.zeros(rows.num_rows, bool)
    for s, e, t, _, sub in _cells(rows):
        w = np.ascontiguousarray(signs[s:e].T)
        codes = _codes(np.unpackbits(signs[s:e].view(np.uint8), axis=1, bitorder="little"), bits, tables)

        def close(a, b, w=w):
            differ = np.zeros((b - a, w.shape[1] - a), np.uint16)
            for x in w:
                differ += np.bitwise_count(x[a:b, None] ^ x[None, a:])
            return differ <= most

        for i, j in _pairs(e - s, sub, close):
            good = _first_here(codes, t, i, j)
            keep[s + i[good]] = keep[s + j[good]] = True
    return rows.filter(pa.array(keep))


def _linked(rows: pa.Table, threshold: float, bits: int, tables: int) -> pa.Table:
    """Counts (a, null, n) and forest edges (a, b, 0) of whole cells, which ``rows`` holds one after another."""
    node, copies, signs = rows.column("node").to_numpy(), rows.column("copies").to_numpy(), _signs(rows)
    vectors, out = rows.column("embedding").chunk(0), [[], [], []]
    for s, e, t, dim, sub in _cells(rows):
        x = scaled(matrix(vectors.slice(s, e - s), dim))
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        codes = _codes(np.unpackbits(signs[s:e].view(np.uint8), axis=1, bitorder="little"), bits, tables)
        n, edges, times, own = np.zeros(e - s), [], copies[s:e], node[s:e]
        for i, j in _pairs(e - s, sub, lambda a, b, x=x: x[a:b] @ x[a:].T >= threshold):
            good = _first_here(codes, t, i, j)
            i, j = i[good], j[good]
            n += np.bincount(i, times[j], e - s) + np.bincount(j, times[i], e - s)
            edges.append(forest(e - s, i, j))
        p, q = forest(e - s, *(np.concatenate([x[k] for x in edges]) for k in (0, 1)))
        some = np.flatnonzero(n)
        out[0] += [own[some], own[p]]
        out[1] += [np.full(len(some), -1), own[q]]
        out[2] += [n[some].astype(np.int64), np.zeros(len(p), np.int64)]
    a, b, n = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)
    return pa.Table.from_arrays([pa.array(a), pa.array(b, mask=n > 0), pa.array(n)], ["a", "b", "n"])


def rotation(dim: int) -> np.ndarray:
    """``dim`` orthonormal rows, turned at random, in as many dimensions as a code has bits; more bits than components make the estimates sharper."""
    bits = max(CODE_BITS, -(-dim // 64) * 64)
    return np.linalg.qr(np.random.default_rng([SEED, dim]).normal(size=(bits, dim)))[0].T


def centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector for each length (0 where it isn't finite); only sums of whole partitions reach the driver."""

    def run(batches):
        sums = {}
        for batch in batches:
            v = batch.column(0)
            sizes = np.array(pa.compute.list_value_length(v))
            for dim in np.unique(sizes):
                x = matrix(v.filter(pa.array(sizes == dim)), int(dim))
                total, n = sums.get(int(dim), (0, 0))
                sums[int(dim)] = (total + x.sum(axis=0), n + len(x))
        yield pa.RecordBatch.from_pydict(
            {"dim": pa.array(list(sums), pa.int32()), "total": pa.array([s[0].tolist() for s in sums.values()], pa.list_(pa.float64())), "n": pa.array([s[1] for s in sums.values()], pa.int64())}
        )

    out = {}
    for r in vectors.select("embedding").mapInArrow(run, "dim int, total array<double>, n bigint").collect():
        total, n = out.get(r["dim"], (0, 0))
        out[r["dim"]] = (total + np.array(r["total"]), n + r["n"])
    means = {dim: total / n for dim, (total, n) in out.items()}
    return {dim: np.where(np.isfinite(m), m, 0) for dim, m in means.items()}


def one_bit_codes(vectors: DataFrame, centre: dict[int, np.ndarray]) -> DataFrame:
    """``vectors(vec_id, embedding)`` with dim, code (the packed signs after centring and rotation), norm of the residual, and ``fit``, its cosine with its own code
    (1 for a residual of zero)."""
    from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

    shared = vectors.sparkSession.sparkContext.broadcast(centre)
    added = [StructField("dim", IntegerType()), StructField("code", BinaryType()), StructField("norm", DoubleType()), StructField("fit", DoubleType())]

    def run(batches):
        turns = {}
        for batch in batches:
            v = batch.column("embedding")
            sizes = np.array(pa.compute.list_value_length(v))
            code, norm, fit = np.empty(len(sizes), object), np.zeros(len(sizes)), np.ones(len(sizes))
            for dim in map(int, np.unique(sizes)):
                if dim not in turns:
                    turns[dim] = rotation(dim)
                at = np.flatnonzero(sizes == dim)
                with np.errstate(all="ignore"):  # where squares overflow there is no bound, and those rows are ranked exactly
                    r = matrix(v.take(pa.array(at)), dim) - shared.value[dim]
                    norm[at] = np.sqrt((r * r).sum(axis=1))
                    r = r @ turns[dim]
                    fit[at] = np.where(norm[at] > 0, np.abs(r).sum(axis=1) / np.where(norm[at] > 0, norm[at], 1) / math.sqrt(r.shape[1]), 1)
                code[at] = [p.tobytes() for p in np.packbits(r > 0, axis=1, bitorder="little")]
            made = [pa.array(sizes, pa.int32()), pa.array(code, pa.binary()), pa.array(norm), pa.array(fit)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), v, *made], ["vec_id", "embedding", *(f.name for f in added)])

    rows = vectors.select("vec_id", "embedding")
    return rows.mapInArrow(run, StructType(rows.schema.fields + added))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nearest of ``vectors`` by Euclidean distance for each row of ``queries``: query_id, rank (from 1), vec_id, score.

    Both are (vec_id, embedding). A query's candidates are all rows with another vec_id and a vector of its length; fewer than ``k``: all. Ties go to the smaller
    vec_id. Unusable vectors and null ids take no part on either side; rows of a repeated vec_id are candidates each. A repeated query id is ranked once, over all its rows
    together. Empty tables: no rows. Other columns are ignored.

    Vectors and their codes lie in shards of SHARD_BYTES, each shuffled once; the queries stream past every shard in blocks. Slice after slice of a shard, inner
    products are estimated from the packed bits by population counts and correction scalars; only candidates whose lower bound of the distance reaches the k-th best
    exact distance so far are ranked exactly. A shard gives at most k rows a query, and Spark keeps the first k within each partition before it shuffles them.
    """
    floats = all(isinstance(f.schema["embedding"].dataType.elementType, FloatType) for f in (vectors, queries))
    kind = "array<float>" if floats else "array<double>"
    good, asked = (f.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast(kind).alias("embedding")) for f in (vectors, queries))
    centre = centres(good)
    size = good.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0)).alias("components")).first()
    shards = max(1, math.ceil(size["components"] * (4 if floats else 8) / SHARD_BYTES), min(64, math.ceil(size["n"] / 512)))
    coded = one_bit_codes(good, centre).withColumns({"shard": F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int"), "asks": F.lit(False)})
    none = {"code": F.lit(None).cast("binary"), "norm": F.lit(None).cast("double"), "fit": F.lit(None).cast("double"), "asks": F.lit(True)}
    asked = asked.withColumns({"dim": F.size("embedding"), "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), **none})
    both = coded.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "dim", "asks")
    shared = vectors.sparkSession.sparkContext.broadcast(centre)

    def run(batches):
        held = None
        for batch in batches:
            keys = np.array([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "dim", "asks")])
            starts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))) if batch.num_rows else []
            for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                key = tuple(keys[:2, s].tolist())
                if held is None or held.key != key:
                    held = Shard(key, shared.value[key[1]] if key[1] in shared.value else None, k)
                part = batch.slice(s, e - s)
                if not keys[2, s]:
                    held.add(part)
                elif held.ids:
                    for a in range(0, e - s, QUERY_BLOCK):
                        yield held.search(part.slice(a, QUERY_BLOCK))

    found = both.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


class Shard:
    """The vectors of one shard and length, with their codes, that queries stream past."""

    def __init__(self, key: tuple[int, int], centre: np.ndarray | None, k: int):
        self.key, self.centre, self.k = key, centre, k
        self.ids, self.norm, self.fit, self.code, self.x = [], [], [], [], []
        self.ready = False

    def add(self, rows: pa.RecordBatch) -> None:
        for c, held in (("vec_id", self.ids), ("norm", self.norm), ("fit", self.fit)):
            held.append(rows.column(c).to_numpy().copy())
        self.code.append(words(rows.column("code")))
        self.x.append(rows.column("embedding").flatten().to_numpy().reshape(-1, self.key[1]).copy())

    def _prepare(self) -> None:
        for name in ("ids", "norm", "fit", "code", "x"):
            setattr(self, name, [np.concatenate(getattr(self, name))])
        self.turn, self.ready = rotation(self.key[1]), True

    def search(self, asked: pa.RecordBatch) -> pa.RecordBatch:
        if not self.ready:
            self._prepare()
        query_ids, q, k = asked.column("vec_id").to_numpy(), matrix(asked.column("embedding"), self.key[1]), self.k
        (ids,), (norm,), (fit,), (code,), (x,) = self.ids, self.norm, self.fit, self.code, self.x
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
        with np.errstate(all="ignore"):
            turned = Turned(q - self.centre, self.turn)
            for a in range(0, len(ids), SLICE_ROWS):
                rows = slice(a, a + SLICE_ROWS)
                middle, low = turned.distances(code[rows], norm[rows], fit[rows])
                for c in range(len(q)):
                    others = ids[rows] != query_ids[c]
                    best_ids, best_at = best[c]
                    if len(best_ids) == k:
                        limit = best_at[-1] ** 2
                    else:
                        near = np.flatnonzero(others)
                        near = near[np.argpartition(middle[c, near], k - 1)[:k]] if len(near) > k else near
                        limit = (distances(x[rows][near], q[c]) ** 2).max() if len(near) == k else np.inf
                    at = np.flatnonzero(others & (low[c] <= limit * (1 + 1e-9) + 1e-12)) + a
                    if len(at):
                        new_ids, new_at = np.concatenate([best_ids, ids[at]]), np.concatenate([best_at, distances(x[at], q[c])])
                        order = np.lexsort((new_ids, new_at))[:k]
                        best[c] = new_ids[order], new_at[order]
        sizes = [len(b[0]) for b in best]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(query_ids, sizes)), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))], ["query_id", "vec_id", "score"]
        )


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; where the squares overflow or vanish they're taken of scaled differences."""
    d = x.astype(np.float64) - q
    out = np.sqrt((d * d).sum(axis=1))
    odd = np.flatnonzero(~((out > 1e-150) & (out < np.inf)))
    if len(odd):
        d = d[odd]
        most = np.abs(d).max(axis=1)
        fine = (most > 0) & np.isfinite(most)
        d, most = d[fine], most[fine]
        out[odd[fine]] = most * np.sqrt(((d / most[:, None]) ** 2).sum(axis=1))
    return out


class Turned:
    """Residuals of queries, rotated and rounded to PLANES bits a component, which lie as bit planes next to the codes of vectors."""

    PLANES = 4

    def __init__(self, residual: np.ndarray, turn: np.ndarray):
        self.size = np.sqrt((residual * residual).sum(axis=1))
        unit = (residual / np.where(self.size > 0, self.size, 1)[:, None]) @ turn
        unit = np.where(np.isfinite(unit), unit, 0)
        self.least = unit.min(axis=1)
        self.step = np.maximum(unit.max(axis=1) - self.least, 1e-300) / (2**self.PLANES - 1)
        level = np.rint((unit - self.least[:, None]) / self.step[:, None]).astype(np.uint8)
        rounded = self.least[:, None] + self.step[:, None] * level
        self.total, self.bits = rounded.sum(axis=1), turn.shape[1]
        self.rounding = np.sqrt(((unit - rounded) ** 2).sum(axis=1)) / math.sqrt(self.bits)
        self.planes = [np.packbits(level >> b & 1, axis=1, bitorder="little").view(np.uint64) for b in range(self.PLANES)]

    def distances(self, code: np.ndarray, norm: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates and lower bounds of squared distances, a row for each query; -inf where there is no bound."""
        by_word = np.ascontiguousarray(code.T)
        ones = np.bitwise_count(by_word).sum(axis=0, dtype=np.int32)
        levels = np.zeros((len(self.size), len(code)), np.int32)
        for b, plane in enumerate(self.planes):
            count = np.zeros(levels.shape, np.uint16)
            for w, word in enumerate(by_word):
                count += np.bitwise_count(plane[:, w, None] & word[None, :])
            levels += count.astype(np.int32) << b
        inner = 2 * (self.least[:, None] * ones + self.step[:, None] * levels) - self.total[:, None]
        estimate = inner / (math.sqrt(self.bits) * fit)
        error = WIDTH * (np.sqrt(np.maximum(1 / fit**2 - 1, 0)) / math.sqrt(max(1, self.bits - 1)) + self.rounding[:, None] / fit) + 1e-6
        base, scale = norm**2 + self.size[:, None] ** 2, 2 * norm * self.size[:, None]
        middle, low = base - scale * estimate, base * (1 - 1e-9) - scale * np.minimum(1, estimate + error)  # less what rounding may take from base
        low[~np.isfinite(low)] = -np.inf
        middle[~np.isfinite(middle)] = -np.inf
        return middle, low
