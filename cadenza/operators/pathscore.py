"""Boundaries scored along an alignment path: steps (ref_label, ref_us, test_label, test_us), gaps with the label ``-`` and null times, as an array ``path`` a pair or as rows with their ``step``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import mean_ms

GAP, EDGE = "-", "<utterance_edge>"


def paths(aligned: DataFrame, key: list[str]) -> DataFrame:
    """Aligned packed pairs (gold, hyp, steps) -> key, path."""

    def side(name, i):
        return F.get(F.col(name), i)

    def step(s):
        g, h = side("gold", s["g"]), side("hyp", s["h"])
        return F.struct(F.coalesce(g["label"], F.lit(GAP)).alias("ref_label"), g["start_us"].alias("ref_us"), F.coalesce(h["label"], F.lit(GAP)).alias("test_label"), h["start_us"].alias("test_us"))

    return aligned.select(*key, F.transform("steps", step).alias("path"))


def packed(steps: DataFrame, key: list[str]) -> DataFrame:
    """Steps as rows -> a path a key, in order of ``step``."""
    made = F.array_sort(F.collect_list(F.struct("step", "ref_label", "ref_us", "test_label", "test_us")))
    return steps.groupBy(*key).agg(made.alias("path"))


def path_boundaries(steps: DataFrame, key: list[str], edges: bool = False, gaps: bool = False) -> DataFrame:
    """A boundary at the start of every step that has both sides, named by the labels before and after it.

    The first step counts only with ``edges`` (what lies before it is an edge mark); a step right after a gap only with ``gaps``.
    A path is read where it lies: neighbours come from the array, and only boundaries become rows.
    """
    p = steps if "path" in steps.columns else packed(steps, key)

    def boundary(x, i):
        before = F.get("path", i - 1)
        mark = lambda c: F.when(i == 0, EDGE).otherwise(before[c])
        return F.struct(
            i.cast("int").alias("step"), mark("ref_label").alias("prev_ref"), x["ref_label"].alias("ref_label"), mark("test_label").alias("prev_test"), x["test_label"].alias("test_label"),
            x["ref_us"].alias("ref_us"), x["test_us"].alias("test_us"), (x["ref_us"] - x["test_us"]).alias("error_us"),
        )

    def counts(b):
        keep = (b["ref_label"] != GAP) & (b["test_label"] != GAP)
        if not edges:
            keep = keep & (b["step"] > 0)
        return keep if gaps else keep & (b["prev_ref"] != GAP) & (b["prev_test"] != GAP)

    return p.select(*key, F.inline(F.filter(F.transform("path", boundary), counts)))


def agreeing(boundaries: DataFrame, categorize) -> DataFrame:
    """Boundaries whose categories agree on both sides, none unknown; ``categorize(ref, test)`` gives two Columns."""
    (pr, pt), (fr, ft) = categorize(F.col("prev_ref"), F.col("prev_test")), categorize(F.col("ref_label"), F.col("test_label"))
    return boundaries.where((pr == pt) & (fr == ft) & (pr != "unknown") & (fr != "unknown"))


def path_errors(boundaries: DataFrame) -> DataFrame:
    """As rows of an error pool: a single edge, hypothesis minus reference."""
    return boundaries.withColumns({"edge": F.lit("boundary"), "signed_us": -F.col("error_us"), "abs_us": F.abs("error_us")}).drop("error_us")


def attempts(gold: DataFrame, hyp: DataFrame, cell: list[str]) -> DataFrame:
    """The pairs of each cell: cell, utt_id, attempted (both tiers hold intervals). A hypothesis that is missing or empty is no pair; one without a reference isn't attempted."""
    there = gold.select("utt_id").distinct().withColumn("attempted", F.lit(True))
    return hyp.select(*cell, "utt_id").distinct().join(there, "utt_id", "left").select(*cell, "utt_id", F.coalesce("attempted", F.lit(False)).alias("attempted"))


def score_cells(results: DataFrame, tried: DataFrame, families: DataFrame, category, cell: list[str]) -> DataFrame:
    """Cells under the path protocol: cell, state, n, mae_ms, signed_ms, n_attempted, n_failed.

    ``tried`` is what ``attempts`` gave, ``results`` has the paths of (cell, utt_id) that came back, and ``families(system, family)`` says whose labels a mapping fits. State:
    ``skipped`` for a system without a family (nothing is counted), ``empty`` where nothing was attempted, ``failed`` where no path came back, else ``scored``. Failed are
    attempted pairs without a path; what was never attempted isn't a failure.
    """
    known = families.select("system", F.lit(True).alias("_known")).distinct()
    got = results.select(*cell, "utt_id").distinct().withColumn("_done", F.lit(True))
    all_cells = tried.join(got, [*cell, "utt_id"], "left").groupBy(*cell).agg(
        F.sum(F.col("attempted").cast("bigint")).alias("n_attempted"), F.sum((F.col("attempted") & F.col("_done").isNull()).cast("bigint")).alias("n_failed")
    )
    fits = results.join(known, "system").drop("_known").join(tried.where("attempted").select(*cell, "utt_id"), [*cell, "utt_id"], "left_semi")
    pool = path_errors(agreeing(path_boundaries(fits, [*cell, "utt_id"]), category)).groupBy(*cell)
    pool = pool.agg(F.count("*").alias("n"), mean_ms(F.col("abs_us")).alias("mae_ms"), mean_ms(F.col("signed_us")).alias("signed_ms"))
    state = F.when(F.col("_known").isNull(), "skipped").when(F.col("n_attempted") == 0, "empty").when(F.col("n_attempted") == F.col("n_failed"), "failed").otherwise("scored")
    counted = lambda c: F.when(F.col("_known"), F.col(c)).alias(c)
    out = all_cells.join(known, "system", "left").join(pool, cell, "left").withColumn("state", state)
    return out.select(*cell, "state", "n", "mae_ms", "signed_ms", counted("n_attempted"), counted("n_failed"))
