"""Scoring of whole tables end to end, by one set of options."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phones
from . import metrics as M
from . import scoring as S
from .align import align_labels, align_times, by_label, by_time


@dataclass(frozen=True)
class Options:
    """What may be chosen. ``matcher``: labels alone, or labels, classes and times (``weight`` to a second). ``by_class``: errors are pooled over aligned pairs of one
    class, not of one label. ``drop``: labels, in lower case, that leave both tiers before aligning. ``interior``: no boundaries beside silence."""

    matcher: str = "labels"
    weight: float = 2.0
    by_class: bool = True
    drop: tuple[str, ...] = ()
    interior: bool = False
    thresholds_ms: tuple[int, ...] = (10, 50, 100)
    primary_ms: int = 25
    tolerance_us: int = 20_000
    least: int = M.LEAST
    replicates: int = 1000
    seed: int = 0

    def __post_init__(self):
        if self.matcher not in ("labels", "times"):
            raise ValueError(f"unknown matcher {self.matcher!r}")


def aligned(gold: DataFrame, hyp: DataFrame, classify: Callable[[Column], Column], options: Options = Options()) -> DataFrame:
    """Packed pairs with their steps."""
    if options.drop:
        from .tiers import drop_labels

        gold, hyp = drop_labels(gold, ["utt_id"], options.drop), drop_labels(hyp, S.PAIR, options.drop)
    gold, hyp = (t.withColumn("cls", classify(F.col("label"))) for t in (gold, hyp))  # before packing, where it's compiled
    return stepped(S.pair(gold, hyp, ("cls",)), options)


def aligned_pairs(pairs: DataFrame, classify: Callable[[Column], Column], options: Options = Options()) -> DataFrame:
    """As ``aligned``, from tiers that are packed and paired already: no shuffle."""
    return stepped(_classed(pairs, classify, options), options)


def _classed(pairs: DataFrame, classify: Callable[[Column], Column], options: Options) -> DataFrame:
    if options.drop:
        from .tiers import drop_packed

        pairs = drop_packed(pairs, options.drop)
    held = lambda side: F.transform(side, lambda x: x.withField("cls", classify(x["label"])))
    return pairs.withColumns({"gold": held("gold"), "hyp": held("hyp")})


def tallied(pairs: DataFrame, classify: Callable[[Column], Column], options: Options = Options()) -> DataFrame:
    """Packed pairs aligned and counted, a short row a pair: what ``leaderboard_of`` reads more than once. No shuffle."""
    steps_of = by_label if options.matcher == "labels" else lambda batch, weight=options.weight: by_time(batch, weight=weight)
    return S.tallies(_classed(pairs, classify, options), steps_of, options.tolerance_us, options.by_class, options.interior)


def stepped(pairs: DataFrame, options: Options) -> DataFrame:
    return align_labels(pairs) if options.matcher == "labels" else align_times(pairs, weight=options.weight)


def errors(pairs: DataFrame, classify: Callable[[Column], Column], options: Options = Options()) -> DataFrame:
    e = S.boundary_errors(pairs, classify, by_class=options.by_class)
    return e.where("left_class <> 'silence' and right_class <> 'silence'") if options.interior else e


def leaderboard(pairs: DataFrame, found: DataFrame, group: list[str], options: Options = Options()) -> DataFrame:
    """A row a cell: rates, pooled errors, boundary detection, underpowered. ``pairs`` and ``found`` are what ``aligned`` and ``errors`` gave, both used more than once."""
    keep = tuple(c for c in group if c not in S.PAIR)
    out = M.edit_rates(S.counters(pairs), group).join(M.summary(found, group, options.thresholds_ms), group, "left")
    out = out.join(M.detection(S.segmentation_packed(pairs, options.tolerance_us, keep), group), group, "left")
    return out.withColumn("underpowered", F.col("n_matched") < options.least)


def leaderboard_of(tallies: DataFrame, group: list[str], options: Options = Options()) -> DataFrame:
    """As ``leaderboard``, from what ``tallied`` gave."""
    edge = lambda e: tallies.select(*group, F.lit(e).alias("edge"), F.explode(e).alias("signed_us"))
    found = edge("onset").unionByName(edge("offset")).withColumn("abs_us", F.abs("signed_us"))
    out = M.edit_rates(tallies, group).join(M.summary(found, group, options.thresholds_ms), group, "left")
    return out.join(M.detection(tallies, group), group, "left").withColumn("underpowered", F.col("n_matched") < options.least)


def leaderboard_of_counts(pooled: DataFrame, counts: DataFrame, group: list[str], options: Options = Options()) -> DataFrame:
    """As ``leaderboard``, from ``scoring.POOLED`` rows and their errors counted (``scoring.counted_errors``)."""
    out = M.edit_rates(pooled, group).join(M.counted_summary(counts, group, options.thresholds_ms), group, "left")
    return out.join(M.detection(pooled, group), group, "left").withColumn("underpowered", F.col("n_matched") < options.least)


def analysis_view(gold: DataFrame, hyp: DataFrame, sources: dict[str, str] | None = None, accent: str = "us", steps_by_class: bool = True) -> DataFrame:
    """Boundary errors as analytics take them, from tiers in their own labels: folded to canonical symbols, aligned, pooled over pairs of one class, with silence told apart.

    Both tiers have ``source``, the set each label is from. ``sources`` overrides it for a side (``gold``, ``hyp``) before folding, as for a system that writes another set than it
    states; an unknown one raises. Deleted labels leave; unmapped ones stay as tokens that match nothing.
    """
    from . import labels as L

    held = phones.label_map(gold.sparkSession, accent)

    def folded(tier: DataFrame, side: str, key: list[str]) -> DataFrame:
        forced = (sources or {}).get(side)
        if forced:
            tier = tier.withColumn("source", F.lit(L.check_source(forced, accent)))
        made = L.prepare_tier(L.canonicalize(tier, held), key)
        apart = F.when(F.startswith("label", F.lit("UNMAPPED:")), F.concat(F.lit(f"{side}:"), "label")).otherwise(F.col("label"))  # one side's unknown is never the other's
        return made.withColumn("label", apart).drop("source")

    options = Options(by_class=steps_by_class)
    pairs = aligned(folded(gold, "gold", ["utt_id"]), folded(hyp, "hyp", S.PAIR), phones.manner, options)
    return S.error_view(errors(pairs, phones.manner, options))
