"""Quality gates: does a reference fit its audio, do conditions and systems cover what they should, do known answers come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6


def frame_levels(samples: Column, size: int, hop: int) -> Column:
    """Level of each frame in dB, as an array; null for waveforms shorter than a frame."""
    level = lambda at: 10 * F.log10(F.aggregate(F.slice(samples, at + 1, size), F.lit(0.0), lambda a, x: a + x * x) / size + 1e-10)
    return F.when(F.size(samples) >= size, F.transform(F.sequence(F.lit(0), F.size(samples) - size, F.lit(hop)), level))


def _mean(levels: Column) -> Column:
    return F.try_divide(F.aggregate(levels, F.lit(0.0), lambda a, x: a + x), F.size(levels))


def _step(levels: Column, at_us: Column, rate: int, hop: int, reach: int) -> Column:
    """Difference in mean level between the ``reach`` frames before and after a time; null where they don't all exist."""
    f = F.floor(at_us * rate / (1_000_000 * hop)).cast("int")
    inside = (f >= reach) & (f + reach < F.size(levels))
    return F.when(inside, F.abs(_mean(F.slice(levels, f + 1, reach)) - _mean(F.slice(levels, f - reach + 1, reach))))


def plausibility(
    waves: DataFrame, tier: DataFrame, key: list[str], silence: Column, hash32: Callable[[Column], Column], rate: int, size: int, hop: int, pad_us: int = 20_000, margin_us: int = 50_000, least: int = 10, more_db: float = 3.0
) -> DataFrame:
    """Whether levels step more where a reference changes between silence and speech than elsewhere.

    ``waves(*key, samples)``, ``tier(*key, pos, start_us, end_us)``; ``silence`` is a test of an interval. Before the first interval is silence. The
    baseline is as many hashed times at least ``margin_us`` inside, ``least`` at the fewest. Returns per key n_boundaries, step_db, baseline_db and plausible
    (null where either has no step). One row a recording after one join; levels never leave their row.
    """
    w = Window.partitionBy(*key).orderBy("pos")
    marked = tier.withColumn("_silent", silence)
    marked = marked.withColumn("_turn", F.col("_silent") != F.coalesce(F.lag("_silent").over(w), F.lit(True)))
    times = marked.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("_turn"), F.col("start_us")))).alias("_at"), F.max("end_us").alias("_dur"))
    d = waves.select(*key, frame_levels(F.col("samples"), size, hop).alias("_levels")).join(times, key)
    reach = max(1, round(pad_us * rate / (1_000_000 * hop)))
    steps = lambda at: F.filter(F.transform(at, lambda t: _step(F.col("_levels"), t, rate, hop, reach)), lambda x: x.isNotNull())
    d = d.withColumn("_steps", steps(F.col("_at")))
    room = F.col("_dur") - 2 * margin_us
    name = F.concat_ws(":", F.lit("pl"), *[F.col(k).cast("string") for k in key])
    drawn = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(least), F.size("_steps"))), lambda i: margin_us + hash32(F.concat_ws(":", name, i.cast("string"))) % room)
    d = d.withColumn("_base", steps(F.when(room > 0, drawn).otherwise(F.array().cast("array<bigint>"))))
    a, b = _mean(F.col("_steps")), _mean(F.col("_base"))
    return d.select(*key, F.coalesce(F.size("_steps"), F.lit(0)).cast("bigint").alias("n_boundaries"), F.round(a, DIGITS).alias("step_db"), F.round(b, DIGITS).alias("baseline_db"), (a > b + more_db).alias("plausible"))


def coverage_gaps(table: DataFrame, member: str, split: str) -> DataFrame:
    """(member, split) combinations that no row has, although each of both occurs: members x splits, both small dimensions, without those seen."""
    seen = table.select(member, split).distinct()
    splits = seen.select(split).distinct()
    want = seen.select(member).distinct().crossJoin(splits)  # as many rows as the answer may have; Spark broadcasts the smaller side if its size allows
    return want.join(seen, [member, split], "left_anti")


def coverage_summary(table: DataFrame, member: str, split: str) -> DataFrame:
    """n_splits, n_most (members of the largest) and whether every split has the same members: each as many as there are in all."""
    seen = table.select(member, split).distinct()
    sizes = seen.groupBy(split).agg(F.count("*").alias("_n"))
    whole = seen.agg(F.countDistinct(member).alias("_all"))  # a single row
    sizes = sizes.agg(F.count("*").alias("n_splits"), F.coalesce(F.max("_n"), F.lit(0)).alias("n_most"), F.coalesce(F.min("_n"), F.lit(0)).alias("_least"))
    return sizes.crossJoin(whole).select("n_splits", "n_most", (F.col("_least") == F.col("_all")).alias("same"))


def link_degraded(gold: DataFrame, media: DataFrame, expected_absent: Column, key: str = "utt_id") -> DataFrame:
    """state (linked, excluded, missing) of every reference by whether degraded media has its id; ``expected_absent`` says which may lack one."""
    m = media.select(key).distinct().withColumn("_has", F.lit(True))
    state = F.when(F.col("_has"), "linked").when(expected_absent, "excluded").otherwise("missing")
    return gold.select(key).distinct().join(m, key, "left").select(key, state.alias("state"))


def one_kind(table: DataFrame, system: str = "system", kind: str = "kind") -> DataFrame:
    """Systems that are in more than one track: system, n_kinds. A sound table gives none."""
    return table.groupBy(system).agg(F.countDistinct(kind).alias("n_kinds")).where("n_kinds > 1")


def rank_within(table: DataFrame, track: list[str], metric: str, member: str = "system") -> DataFrame:
    """Adds place by ``metric`` (smallest first, ties share one) inside each track; rows without a value have none. Tracks never share a ranking."""
    place = F.rank().over(Window.partitionBy(*track).orderBy(F.col(metric).asc_nulls_last()))
    return table.withColumn("place", F.when(F.col(metric).isNotNull(), place))


def cell_status(expected: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    """Expected cells with n_records and status: ``done``, or ``empty`` where ``have(key, n_records)`` has no row or none."""
    s = expected.select(*key).join(have, key, "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))
    return s.withColumn("status", F.when(F.col("n_records") > 0, "done").otherwise("empty"))


def identical_conditions(hyp: DataFrame, group: list[str], limit: float) -> DataFrame:
    """For each pair of conditions of a group the share of utterances in both whose intervals are the same; ok below ``limit``.

    ``hyp(group, utt_id, cond, pos, label, start_us, end_us)``. An utterance's intervals are packed once and its few conditions meet in one join on it.
    """
    t = hyp.groupBy(*group, "utt_id", "cond").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "start_us", "end_us"))).alias("t"))
    t = t.withColumn("t", F.transform("t", lambda x: F.struct(x["label"], x["start_us"], x["end_us"])))
    a, b = t.withColumnsRenamed({"cond": "cond_a", "t": "ta"}), t.withColumnsRenamed({"cond": "cond_b", "t": "tb"})
    same = F.sum((F.col("ta") == F.col("tb")).cast("bigint"))
    pairs = a.join(b, [*group, "utt_id"]).where("cond_a < cond_b").groupBy(*group, "cond_a", "cond_b").agg(F.count("*").alias("n"), same.alias("n_same"))
    share = F.col("n_same") / F.col("n")
    return pairs.select("*", F.round(share, 9).alias("share"), (share < limit).alias("ok"))


def ingest_summary(tier: DataFrame, report: DataFrame, group: str) -> DataFrame:
    """Per group: utterances, speakers and intervals of ``tier``, errors and warnings of ``report(group, severity)``."""
    n = lambda s: F.sum((F.col("severity") == s).cast("bigint"))
    found = report.groupBy(group).agg(n("error").alias("n_errors"), n("warning").alias("n_warnings"))
    made = tier.groupBy(group).agg(F.countDistinct("utt_id").alias("n_utts"), F.countDistinct("speaker_id").alias("n_speakers"), F.count("*").alias("n_intervals"))
    return made.join(found, group, "left").fillna(0, ["n_errors", "n_warnings"])


def strata(members: DataFrame, side: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Members and their utterances in each combination of ``by``, columns of ``side(key, ...)``."""
    return members.join(side, key).groupBy(*by).agg(F.countDistinct(key).alias(f"n_{key.removesuffix('_id')}s"), F.count("*").alias("n_utts"))


def snr_gate(measured: DataFrame, tolerance_db: float = 0.5) -> DataFrame:
    """``measured(item_id, snr_db, achieved_db, n_clean, n_mixed)`` with error_db and ok: as long as the clean one, and its SNR within the tolerance. A silent noise achieves none."""
    error = F.abs(F.col("achieved_db") - F.col("snr_db"))
    return measured.withColumns({"error_db": error, "ok": (F.col("n_clean") == F.col("n_mixed")) & F.coalesce(error < tolerance_db, F.lit(False))})
