"""Report tables over leaderboards: pivots, summaries, orders. Rounding is for display only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def condition_grid(lb: DataFrame, key: list[str], metric: str, conditions: list[str], column: str = "cond") -> DataFrame:
    """One row per key, a column per condition."""
    return lb.groupBy(*key).pivot(column, conditions).agg(F.first(metric))


def clean_vs_noisy(lb: DataFrame, key: list[str], metrics: list[str], noisy: list[str], clean: str = "clean", column: str = "cond") -> DataFrame:
    """Clean value and the mean over exactly the ``noisy`` conditions (null if one is missing) of each metric."""
    out = []
    for m in metrics:
        mean = F.round(F.avg(F.when(F.col(column).isin(*noisy), F.col(m))), 9)
        n = F.count(F.when(F.col(column).isin(*noisy), F.col(m)))
        out += [F.max(F.when(F.col(column) == clean, F.col(m))).alias(f"{m}_clean"), F.when(n == len(noisy), mean).alias(f"{m}_noisy")]
    return lb.groupBy(*key).agg(*out)


def degradation(lb: DataFrame, key: list[str], metric: str, order: list[str], column: str = "cond", tolerance: float = 0.15) -> DataFrame:
    """Whether a metric worsens along ``order`` (mildest first): each step's change, and ok unless it improves by more than ``tolerance``. Nulls are passed over."""
    rank = F.array_position(F.array(*[F.lit(c) for c in order]), F.col(column))
    w = Window.partitionBy(*key).orderBy("step")
    s = lb.where(F.col(metric).isNotNull()).withColumn("step", rank).where("step > 0").withColumn("before", F.lag(metric).over(w))
    return s.select(*key, column, "step", metric, F.round(F.col(metric) / F.col("before"), 9).alias("ratio"), F.coalesce(F.col(metric) >= F.col("before") * (1 - tolerance), F.lit(True)).alias("ok"))


def type_panel(per_type: DataFrame, row: list[str], systems: list[str], least: int) -> DataFrame:
    """Rows are left-right types, columns systems, cells the mean error, marked ``*`` where there are fewer than ``least`` boundaries."""
    cell = F.concat(F.format_string("%.1f", F.round("mae_ms", 1)), F.when(F.col("n") < least, "*").otherwise(""))
    return per_type.withColumn("cell", cell).groupBy(*row).pivot("system", systems).agg(F.first("cell"))


def transfer(lb: DataFrame, a: str, b: str, key: list[str], metric: str = "mae_ms") -> DataFrame:
    """Change of a metric from corpus ``a`` to ``b`` per key, and the range of recall."""
    x = lb.where(F.col("corpus") == a).select(*key, F.col(metric).alias("from_value"), F.col("arr").alias("arr_a"))
    y = lb.where(F.col("corpus") == b).select(*key, F.col(metric).alias("to_value"), F.col("arr").alias("arr_b"))
    return x.join(y, key).select(*key, "from_value", "to_value", F.round(F.col("to_value") - F.col("from_value"), 9).alias("delta"), F.least("arr_a", "arr_b").alias("arr_low"), F.greatest("arr_a", "arr_b").alias("arr_high"))


def family_order(lb: DataFrame, families: DataFrame, metric: str) -> DataFrame:
    """Adds place: by family rank, then worst first within it, nulls before all. ``families(system, family, family_rank)`` is a small dimension; unknown systems come last."""
    j = lb.join(F.broadcast(families), "system", "left")
    # a display table has a row a system; its order is one window over it
    return j.withColumn("place", F.row_number().over(Window.orderBy(F.col("family_rank").asc_nulls_last(), F.col(metric).desc_nulls_first(), "system")))


def split_comparison(lb: DataFrame, metric: str, splits: list[str], hidden: list[str]) -> DataFrame:
    """One row per system and condition with the splits side by side, without hidden systems; ``value`` is the first split's that has one."""
    wide = lb.where(~F.col("system").isin(*hidden)).groupBy("system", "cond").pivot("corpus", splits).agg(F.first(metric))
    return wide.withColumn("value", F.coalesce(*splits))


def would_change(published: DataFrame, new: DataFrame) -> DataFrame:
    """Rows only one of two tables has: side (removed or added) and the row's columns."""
    new = new.select(*published.columns)
    return published.exceptAll(new).withColumn("side", F.lit("removed")).unionByName(new.exceptAll(published).withColumn("side", F.lit("added")))


def view(lb: DataFrame, corpus: str, condition: str, columns: list[str], key: tuple[str, ...] = ("system",)) -> DataFrame:
    """A corpus and condition's rows with chosen columns, and place, their number in order of ``key``. A display table: its order is one window over it."""
    rows = lb.where((F.col("corpus") == corpus) & (F.col("cond") == condition))
    return rows.select(F.row_number().over(Window.orderBy(*key)).alias("place"), *key, *columns)


def condition_parts(condition: Column) -> tuple[Column, Column]:
    """Noise and SNR in dB of ``<noise>_snr<dB>``; a condition without an SNR is its own noise and has a null SNR."""
    snr = F.regexp_extract(condition, r"^(.*)_snr(-?\d+)$", 2)
    return F.when(snr != "", F.regexp_extract(condition, r"^(.*)_snr(-?\d+)$", 1)).otherwise(condition), F.nullif(snr, F.lit("")).cast("int")


def robustness(lb: DataFrame, key: list[str], metric: str, at_snr: int = 10, tolerance: float = 0.15, clean: str = "clean") -> DataFrame:
    """Per key and noise: clean and degraded value at ``at_snr``, their ratio (null for a clean value of 0 or none), and whether the metric never improves by more than
    ``tolerance`` as the SNR falls, the clean value first. Nulls are passed over."""
    noise, snr = condition_parts(F.col("cond"))
    rows = lb.withColumns({"noise": noise, "snr": snr})
    base = rows.where(F.col("cond") == clean).select(*key, F.col(metric).alias("clean"))
    series = F.array_sort(F.collect_list(F.when(F.col(metric).isNotNull(), F.struct((-F.col("snr")).alias("by"), F.col(metric).alias("v")))))
    made = rows.where("snr is not null").groupBy(*key, "noise").agg(series["v"].alias("s"), F.max(F.when(F.col("snr") == at_snr, F.col(metric))).alias("degraded")).join(base, key, "left")
    seq = F.when(F.col("clean").isNull(), F.col("s")).otherwise(F.concat(F.array("clean"), "s"))
    steps = F.transform(seq, lambda x, i: F.coalesce(x >= F.get(seq, i - 1) * (1 - tolerance), F.lit(True)))
    ratio = F.when(F.col("clean") != 0, F.round(F.col("degraded") / F.col("clean"), 9))
    return made.select(*key, "noise", "clean", "degraded", ratio.alias("ratio"), F.forall(steps, lambda x: x).alias("monotone"))


def published(lb: DataFrame, hidden_prefixes: tuple[str, ...] = (), kept: tuple[str, ...] = (), blank: dict[str, tuple[str, ...]] | None = None, concise: bool = False, detailed_only: tuple[str, ...] = ()) -> DataFrame:
    """Without systems that are, or begin with, a hidden name and ``_`` unless they're in ``kept``; columns of the systems in ``blank`` are null.

    A ``concise`` table also goes without the systems in ``detailed_only``, releases of one system, say, that the detailed one compares.
    """
    hidden = F.lit(False)
    for p in hidden_prefixes:
        hidden = hidden | (F.col("system") == p) | F.startswith("system", F.lit(p + "_"))
    rows = lb.where(~hidden | F.col("system").isin(*kept))
    if concise and detailed_only:
        rows = rows.where(~F.col("system").isin(*detailed_only))
    columns = {c for cs in (blank or {}).values() for c in cs}
    return rows.withColumns({c: F.when(~F.col("system").isin(*[s for s, cs in blank.items() if c in cs]), F.col(c)) for c in sorted(columns)})


def shown(value: Column, digits: int = 2, scale: float = 1.0) -> Column:
    """A number for display; nulls are a dash."""
    return F.coalesce(_fixed(value * scale, digits), F.lit("—"))


def _fixed(value: Column, digits: int) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", F.round(value, digits)))


def pair_cell(a: Column, b: Column, digits: int = 3) -> Column:
    return F.concat(shown(a, digits), F.lit("/"), shown(b, digits))


def interval_cell(value: Column, low: Column, high: Column, digits: int = 2) -> Column:
    """``value [low,high]``, or the value alone where there is no interval."""
    return F.concat(shown(value, digits), F.coalesce(F.concat(F.lit(" ["), _fixed(low, digits), F.lit(","), _fixed(high, digits), F.lit("]")), F.lit("")))


def best_covered(lb: DataFrame, key: list[str], split: str, coverage: str) -> DataFrame:
    """Of each key's rows those of the split with the largest summed coverage (ties: the first by name)."""
    by = lb.groupBy(*key, split).agg(F.sum(coverage).alias("_n"))
    best = by.groupBy(*key).agg(F.min_by(split, F.struct(-F.col("_n"), F.col(split))).alias(split))
    return lb.join(best, [*key, split], "left_semi")


def in_reporting_order(lb: DataFrame, subset: str, order: list[str]) -> DataFrame:
    """Adds rank, the subset's place in ``order``; subsets it doesn't name come last."""
    at = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(subset))
    return lb.withColumn("rank", F.when(at > 0, at).otherwise(len(order) + 1).cast("int"))
