"""Sweeps over cells, and which track a system belongs to."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .systems import KINDS

STATUS = "status string, seconds double, records bigint, error string"


def run_sweep(spark: SparkSession, cells: Iterable[tuple[tuple, Callable[[], DataFrame]]], key: list[str], write: Callable[[DataFrame, tuple], None]) -> DataFrame:
    """Makes and writes one cell after another: key, status, seconds, records, error.

    ``cells`` are (values of ``key``, a function that plans the cell). Records are counted by an observation on the job that writes them, so no cell is computed or read twice.
    ``OK``; ``EMPTY`` where the job ended well without a record; ``FAIL`` where it didn't end well; ``CONFIG_FAIL`` where it couldn't be planned. A failed cell stops no other. The
    driver holds a row a cell.
    """
    rows = []
    for name, plan in cells:
        began = time.perf_counter()
        try:
            made = plan()
        except Exception as e:  # noqa: BLE001  a cell's failure is a row, not the sweep's end
            rows.append((*name, "CONFIG_FAIL", 0.0, 0, first_line(e)))
            continue
        seen = Observation()
        try:
            write(made.observe(seen, F.count(F.lit(1)).alias("n")), name)
            n = int(seen.get["n"])
            rows.append((*name, "OK" if n else "EMPTY", time.perf_counter() - began, n, None))
        except Exception as e:  # noqa: BLE001
            rows.append((*name, "FAIL", time.perf_counter() - began, 0, first_line(e)))
    return spark.createDataFrame(rows, ", ".join([*(f"{k} string" for k in key), STATUS]))


def first_line(e: Exception) -> str:
    return f"{type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}"[:300]


def _place(path: Column) -> dict[str, Column]:
    """kind, folder and what follows of ``…/<kind>/<tool>/…``; tools may lie deeper, as ``<tool>/exps/<name>`` or ``<tool>/v<version>``."""
    parts = F.split(path, "/")
    at = F.array_max(F.transform(F.array(*[F.lit(k) for k in KINDS]), lambda k: F.array_position(parts, k))).cast("int")
    rest = F.when(at > 0, F.slice(parts, at + 1, F.greatest(F.size(parts) - at, F.lit(0))))
    second = F.get(rest, F.lit(1))
    own = F.when((second == "exps") & (F.size(rest) > 3), 3).when(second.rlike("^v") & (F.size(rest) > 2), 2).otherwise(1)
    return {"kind": F.get(parts, at - 1), "folder": F.element_at(rest, own), "file": F.array_join(F.slice(rest, own + 1, F.greatest(F.size(rest) - own, F.lit(0))), "/")}


def declared_tools(recipes: DataFrame) -> DataFrame:
    """Recipes(path: …/<kind>/<tool>/config.yaml, content) -> tool, kind, path.

    A recipe's ``name:`` is the tool's, else its folder's name. Of several recipes with one name that of the first kind counts, then the first by path; a file elsewhere is no recipe.
    """
    named = F.regexp_extract("content", r"(?m)^name:[ \t]*['\"]?([^'\"#\n]*?)['\"]?[ \t]*(?:#.*)?$", 1)
    p = _place(F.col("path"))
    r = recipes.select("path", F.when(named != "", named).alias("name"), *[c.alias(k) for k, c in p.items()]).where("kind is not null and file = 'config.yaml'")
    order = F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")), F.col("path"))
    return r.groupBy(F.coalesce("name", "folder").alias("tool")).agg(F.min_by("kind", order).alias("kind"), F.min_by("path", order).alias("path"))


def tracks(tools: DataFrame, files: DataFrame, recipes: DataFrame) -> DataFrame:
    """``tools(system)`` -> system, kind, origin: the kind of its recipe (``recipe``), else of the first kind that has files of its name (``folder``), else the first (``default``).

    ``files(path)`` is a listing. A folder alone says little, as logs and results make folders too: where there is a recipe anywhere, folders don't count.
    """
    p = _place(F.col("path"))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("_k"))
    there = files.select(p["kind"].alias("_k"), F.get(F.split(F.col("path"), "/"), F.array_position(F.split(F.col("path"), "/"), p["kind"]).cast("int")).alias("system"))
    there = there.where("_k is not null").groupBy("system").agg(F.min_by("_k", order).alias("_folder"))
    t = tools.select("system").distinct().join(declared_tools(recipes).select(F.col("tool").alias("system"), F.col("kind").alias("_recipe")), "system", "left").join(there, "system", "left")
    origin = F.when(F.col("_recipe").isNotNull(), "recipe").when(F.col("_folder").isNotNull(), "folder").otherwise("default")
    return t.select("system", F.coalesce("_recipe", "_folder", F.lit(KINDS[0])).alias("kind"), origin.alias("origin"))
