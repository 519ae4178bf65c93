"""Whitening of embeddings: leading eigenvectors of their covariance by spectrum slicing, and every vector projected on them over the root of their eigenvalues.

Counting the positive pivots of an LDL' factorisation of V - s I counts the eigenvalues above s (Sylvester). Counts at a few shifts put every leading eigenvalue into an
interval of its own, Rayleigh quotient iteration converges on it from there, and two counts beside the result prove that it has the number it's given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import matrix

#: An entry c becomes floor(SCALE * c) + OFFSET; farther from 0 than FARTHEST it counts as that.
SCALE, OFFSET, FARTHEST = 64, 1_000_000, float(1 << 52)
#: Bunch and Kaufman's bound between pivots of one row and of two; certificates and the rank's bound in units of rounding.
ALPHA, SLACK = (1 + 17**0.5) / 8, 64 * np.finfo(np.float64).eps
COMPONENTS, SEED = 32, 7


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``a`` are above ``shift``: positive pivots of LDL' with pivots of one or two rows (Bunch and Kaufman's choice)."""
    a, count, k = a - shift * np.eye(len(a)), 0, 0

    def swap(i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while k < len(a):
        below = np.abs(a[k + 1 :, k])
        r, rows, here = k + 1 + int(below.argmax()) if len(below) else k, 1, abs(a[k, k])
        most = below.max(initial=0)
        if here == most == 0:
            k += 1
            continue
        if here < ALPHA * most:
            across = np.abs(a[k:, r])
            across[r - k] = 0
            if here * across.max() < ALPHA * most**2:
                if abs(a[r, r]) >= ALPHA * across.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    rows = 2
        end = k + rows
        count += int(a[k, k] > 0) if rows == 1 else 1  # such a block of two has one eigenvalue on either side
        side = a[end:, k:end]
        a[end:, end:] -= side @ (np.linalg.solve(a[k:end, k:end], side.T) if rows == 2 else side.T / a[k, k])
        k = end
    return count


def _solve(a: np.ndarray, shift: float, v: np.ndarray, nudge: float) -> np.ndarray:
    """(a - shift I) w = v, w of length 1; a shift that hits an eigenvalue exactly is moved by ``nudge``."""
    while True:
        try:
            w = np.linalg.solve(a - shift * np.eye(len(a)), v)
        except np.linalg.LinAlgError:
            w = np.array([np.inf])
        if np.isfinite(w).all():
            return w / np.linalg.norm(w)
        shift, nudge = shift + nudge, 2 * nudge


def leading(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues above 0, falling, and their unit vectors as columns; fewer where the rank is lower.

    Equal eigenvalues can't be told apart by counts: their vectors are any that are orthogonal. Raises ArithmeticError where a number can't be proved.
    """
    size = np.abs(a).sum(axis=1).max() if len(a) else 0.0  # no eigenvalue is farther from 0
    least, rng = SLACK * len(a) * size, np.random.default_rng(SEED)
    counts = {-size - least: len(a), size + least: 0}

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(a, shift)
        return counts[shift]

    values, vectors = [], np.zeros((len(a), 0))
    for k in range(1, min(most, count(least)) + 1 if size else 1):
        low, high = max(s for s, n in counts.items() if n >= k), min(s for s, n in counts.items() if n < k)
        while True:
            while (counts[low] != k or counts[high] != k - 1) and high - low > least:  # alone in its interval, or as good as equal to its neighbours
                middle = (low + high) / 2
                low, high = (middle, high) if count(middle) >= k else (low, middle)
            v, shift = rng.normal(size=len(a)), (low + high) / 2
            for step in range(12):
                v = v - vectors @ (vectors.T @ v)
                v = _solve(a, shift, v / np.linalg.norm(v), least / 8)
                v = v - vectors @ (vectors.T @ v)
                v /= np.linalg.norm(v)
                value = float(v @ a @ v)
                if np.linalg.norm(a @ v - value * v) <= least / 4:
                    break
                if step:  # once by the interval's middle, then by the quotient
                    shift = value
            if count(value - 2 * least) >= k > count(value + 2 * least):
                break
            if high - low <= least / 4:
                raise ArithmeticError(f"eigenvalue {k} isn't certain")
            middle = (low + high) / 2  # drawn away to another: start nearer
            low, high = (middle, high) if count(middle) >= k else (low, middle)
        values.append(value)
        vectors = np.column_stack([vectors, v])
    return np.array(values), vectors


@dataclass(frozen=True)
class Whitening:
    """What vectors of one length are whitened by: their number and integer sums, the eigenvalues kept with their vectors, the covariance's trace, and what whitening leaves of the identity."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0


def finite(v: Column) -> Column:
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def by_length(batches, name: str = "embedding"):
    """Rows of each batch whose vectors have one length: (that length, their places, integers x)."""
    for batch in batches:
        v = batch.column(name)
        sizes = np.asarray(pa.compute.list_value_length(v))
        for dim in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == dim)
            c = matrix(v.take(pa.array(at)), int(dim))
            yield batch, int(dim), at, np.clip(np.floor(SCALE * np.clip(c, -FARTHEST, FARTHEST)), -FARTHEST, FARTHEST).astype(np.int64) + OFFSET


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exact: 64-bit integers where they hold, else Python's."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    return n * x - np.array(sums, np.int64) if largest < 1 << 62 else n * x.astype(object) - np.array(sums, object)


def squares(d: np.ndarray) -> list[int | None]:
    """Sums of squares of rows, exact; null beyond a long."""
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    return [s if (s := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in d]


def _sums(rows: DataFrame) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Number and sum of the integers by length; whole numbers, so the order of rows doesn't matter."""

    def add(batches):
        held: dict[int, list] = {}
        for _, dim, _, x in by_length(batches):
            part = x.sum(axis=0) if int(np.abs(x).max(initial=0)) * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
            n, s = held.get(dim, (0, 0))
            held[dim] = [n + len(x), s + part.astype(object)]
        for dim, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([n]), pa.array([list(map(int, s))], pa.list_(pa.decimal128(38, 0)))], ["dim", "n", "sums"])

    parts = rows.mapInArrow(add, "dim int, n bigint, sums array<decimal(38,0)>").select("dim", "n", F.posexplode("sums").alias("i", "s"))
    out: dict[int, list] = {}
    for r in parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim", "i").collect():  # a row an entry of a vector
        out.setdefault(r["dim"], [r["n"], []])[1].append(int(r["s"]))
    return {dim: (n, tuple(s)) for dim, (n, s) in out.items()}


def _products(rows: DataFrame, centred: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Sum over rows of y y' by length, y = ``centred`` of the integers. Partitions give a matrix each, rows of which are added up apart."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for _, dim, _, x in by_length(batches):
            y = centred(dim, x)
            held[dim] = held.get(dim, 0) + y.T @ y
        yield from _as_rows({(dim, i): row for dim, g in held.items() for i, row in enumerate(g)})

    def merge(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for dim, i, row in zip(*(batch.column(c).to_pylist() for c in ("dim", "i")), batch.column("row"), strict=True):
                held[dim, i] = held.get((dim, i), 0) + row.values.to_numpy()
        yield from _as_rows(held)

    kind = "dim int, i int, row array<double>"
    out: dict[int, list] = {}
    for r in sorted(rows.mapInArrow(add, kind).repartition("dim", "i").mapInArrow(merge, kind).collect()):  # one matrix a length
        out.setdefault(r["dim"], []).append(r["row"])
    return {dim: np.array(g) for dim, g in out.items()}


def _as_rows(held: dict[tuple[int, int], np.ndarray]):
    if held:
        dims, places = zip(*held, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(places, pa.int32()), pa.array([r.tolist() for r in held.values()], pa.list_(pa.float64()))], ["dim", "i", "row"])


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """What whitens each length of vector: three passes (sums, covariance, covariance of the whitened). The driver holds a matrix of a vector's length."""
    rows = vectors.where(finite(F.col("embedding"))).select("embedding")
    sums = _sums(rows)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(sums)

    def centred(dim: int, x: np.ndarray) -> np.ndarray:
        n, s = shared.value[dim]
        return deviations(x, n, s).astype(np.float64) / n

    made = {}
    for dim, g in _products(rows, centred).items():
        v = g / sums[dim][0]
        made[dim] = Whitening(*sums[dim], *leading((v + v.T) / 2, components), float(np.trace(v)))
    held = spark.sparkContext.broadcast(made)
    left = _products(rows, lambda dim, x: project(held.value[dim], deviations(x, *shared.value[dim])))
    return {dim: Whitening(w.n, w.sums, w.values, w.vectors, w.trace, float(np.abs(left[dim] / w.n - np.eye(len(w.values))).max(initial=0))) if len(w.values) else w for dim, w in made.items()}


def project(w: Whitening, d: np.ndarray) -> np.ndarray:
    return d.astype(np.float64) / w.n @ w.vectors / np.sqrt(w.values)


def whiten(vectors: DataFrame, model: dict[int, Whitening] | None = None, components: int = COMPONENTS) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    An entry c counts as the whole number floor(SCALE * c) + OFFSET. ``model`` is ``fit`` of these vectors unless another is given. Components are numbered from 1 by
    falling eigenvalue of the covariance (divisor n, centred before multiplying); there are fewer than ``components`` where the covariance has a lower rank. n is the number of vectors fitted,
    deviation the exact sum of (n * x - sums)^2 (null where it doesn't fit a long), explained the eigenvalue's share of the trace, identity_error how far the whitened vectors'
    covariance is from the identity at most.

    Vectors that are null or hold null or non-finite entries have no rows and no part in anything. Vectors of different lengths are whitened apart. A null or repeated vec_id
    keeps all its rows. One vector, or equal ones only, have no covariance and so no components; an empty table has no rows. Other columns are ignored.
    """
    rows = vectors.where(finite(F.col("embedding"))).select("vec_id", "embedding")
    shared = vectors.sparkSession.sparkContext.broadcast(fit(vectors, components) if model is None else model)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def work(batches):
        for batch, dim, at, x in by_length(batches):
            if dim not in shared.value:
                continue
            w = shared.value[dim]
            d = deviations(x, w.n, w.sums)
            y = project(w, d)
            offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
            columns = {
                "vec_id": batch.column("vec_id").take(pa.array(at)), "n": pa.array(np.full(len(y), w.n)), "deviation": pa.array(squares(d), pa.int64()),
                "whitened": pa.ListArray.from_arrays(offsets, pa.array(y.ravel())), "shares": pa.array([(w.values / w.trace).tolist()] * len(y), pa.list_(pa.float64())), "identity_error": pa.array(np.full(len(y), w.identity_error)),
            }
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    made = rows.mapInArrow(work, f"vec_id {kind}, n bigint, deviation bigint, whitened array<double>, shares array<double>, identity_error double")
    long = made.select("vec_id", "n", "deviation", F.posexplode(F.arrays_zip("whitened", "shares")).alias("k", "at"), "identity_error")
    return long.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", F.col("at")["whitened"].alias("whitened"), F.col("at")["shares"].alias("explained"), "identity_error")
