"""Shared helpers: table access, shared scratch storage and connected components."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources.storage import discard, scratch_path, shared_dir, staged  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read, never a recomputation, and a table read several times is computed once.
    """
    return staged(df, label)[0]


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns that have one of ``names`` in any letter case: outputs take the place of inputs called like them."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


_CACHE: dict = {}


def worker_cache(key, make):
    """What ``make`` gives, kept in this Python worker for tasks to come. Workers outlive stages: another key's cache takes this one's place, so they never add up."""
    if key not in _CACHE:
        drop_caches()
        _CACHE[key] = make()
    else:
        give_back()
    return _CACHE[key]


def drop_caches() -> None:
    """For tasks that keep nothing in their worker: what earlier stages kept there goes."""
    _CACHE.clear()
    give_back()


def give_back() -> None:
    """Memory that this worker has freed goes back to the system: its allocators would hold it while the executor's JVM grows."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc has it, other C libraries don't
        ctypes.CDLL(None).malloc_trim(0)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected graph of ``edges(a long, b long)``.

    Returns ``(node, component)`` for every node with an edge; ``component`` is the smallest node of its component. Null ends and loops
    are ignored; repeated edges count once. An empty table gives an empty result.

    Every round each node points at the neighbour (or itself) with the smallest hash and the graph is contracted along those pointers, so
    node counts shrink geometrically whatever order the ids have. Hub nodes are safe: pointers are minima, combined before the shuffle,
    and the relabelling joins are plain equi-joins that adaptive execution splits. A round's tables go when the next round's are written.
    """
    spark = edges.sparkSession
    live = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    live, edges_at = staged(live.distinct(), "edges")
    mapping, mapping_at = None, None
    while True:
        both = live.select("a", "b").unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("to"))
        best = both.groupBy("a").agg(F.min(ranked).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("to"))
        pointer, pointer_at = staged(best.select(F.col("a").alias("from"), F.least("m", own)["to"].alias("to")), "pointer")
        if mapping is None:
            moved = pointer.select(F.col("from").alias("node"), F.col("to").alias("root"))
        else:
            moved = mapping.join(pointer, mapping["root"] == pointer["from"], "left").select("node", F.coalesce("to", "root").alias("root"))
        done = [mapping_at, edges_at, pointer_at]
        mapping, mapping_at = staged(moved, "mapping")
        left = live.join(pointer, live["a"] == pointer["from"]).select(F.col("to").alias("a"), "b")
        right = left.join(pointer, left["b"] == pointer["from"]).select("a", F.col("to").alias("b"))
        again = right.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        live, edges_at = staged(again.distinct(), "edges")
        for path in done:
            if path:
                discard(spark, path)
        if live.isEmpty():
            break
    smallest = mapping.groupBy("root").agg(F.min("node").alias("component"))
    return mapping.join(smallest, "root").select("node", "component")
