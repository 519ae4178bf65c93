"""The contract for systems under test, and for analytics: user functions by name, run over tables of items."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("aligners", "timestamp_asrs")
INTERVAL = pa.struct([("label", pa.string()), ("start_us", pa.int64()), ("end_us", pa.int64()), ("conf", pa.float64())])
RESULT = "item_id string, words array<struct<label:string,start_us:bigint,end_us:bigint,conf:double>>, meta map<string,string>, error string, rtf double"


@dataclass(frozen=True)
class System:
    """``work`` takes a list of items (dicts) and returns for each (words, meta), or an exception in its place. Words are (label, start_us, end_us, conf)."""

    name: str
    kind: str
    modes: tuple[str, ...]
    work: Callable[[list[dict]], list]

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"{self.name}: unknown kind {self.kind}")


def one_by_one(work: Callable[[dict], tuple]) -> Callable[[list[dict]], list]:
    """A batch form of a function of one item: what it raises stays with that item."""

    def run(items):
        out = []
        for item in items:
            try:
                out.append(work(item))
            except Exception as e:  # noqa: BLE001  user code: an item's failure is a row, not the job's end
                out.append(e)
        return out

    return run


def run_system(items: DataFrame, system: System, mode: str) -> DataFrame:
    """One row per item: item_id, words, meta, error (null if it went well) and rtf (the batch's elapsed time over its audio).

    ``items(item_id, dur_us, ...)``; every column is handed over, but systems that decode by themselves get no transcript. A mode the system doesn't offer
    fails at once. Failed items have no words. A map over Arrow batches, no shuffle.
    """
    if mode not in system.modes:
        raise ValueError(f"{system.name} has no mode {mode}")
    given = items if system.kind == "aligners" else items.drop("transcript")
    work = system.work

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            began = time.perf_counter()
            made = work(rows) if rows else []
            if len(made) != len(rows):
                raise ValueError("a system must answer every item")
            audio = sum(r["dur_us"] or 0 for r in rows) / 1e6
            rtf = (time.perf_counter() - began) / audio if audio else None
            bad = [isinstance(m, Exception) for m in made]
            words = [None if b else [dict(zip(("label", "start_us", "end_us", "conf"), w, strict=True)) for w in m[0]] for m, b in zip(made, bad, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["item_id"] for r in rows], pa.string()), pa.array(words, pa.list_(INTERVAL)),
                    pa.array([None if b else list((m[1] or {}).items()) for m, b in zip(made, bad, strict=True)], pa.map_(pa.string(), pa.string())),
                    pa.array([f"{type(m).__name__}: {m}" if b else None for m, b in zip(made, bad, strict=True)], pa.string()), pa.array([rtf] * len(rows), pa.float64()),
                ],
                ["item_id", "words", "meta", "error", "rtf"],
            )

    return given.mapInArrow(run, RESULT)


class Analytics:
    """Named functions DataFrame -> DataFrame in the order they were added; a name is taken once."""

    def __init__(self):
        self.held: dict[str, tuple[str, Callable[..., DataFrame]]] = {}

    def add(self, name: str, title: str):
        def keep(fn):
            if name in self.held:
                raise ValueError(f"{name} is taken")
            self.held[name] = (title, fn)
            return fn

        return keep

    def run(self, name: str, *args, **options) -> DataFrame:
        return self.held[name][1](*args, **options)
