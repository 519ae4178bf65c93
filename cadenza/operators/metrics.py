"""Metrics as Columns over pools of boundary errors (abs_us, signed_us) or over summed counters, and a registry of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resample import POISSON, exact_sums, poisson_sums  # noqa: F401

DIGITS = 9
#: A cell with fewer matches is underpowered.
LEAST = 30


def r(x: Column) -> Column:
    return F.round(x, DIGITS)


def ratio(a: Column | str, b: Column | str, scale: float = 1.0) -> Column:
    """a / b scaled, null where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return r(F.when(b != 0, scale * a.cast("double") / b.cast("double")))


def share(test: Column, scale: float = 1.0) -> Column:
    """Share of rows that pass; null for no rows."""
    return ratio(F.sum(test.cast("bigint")), F.count(test), scale)


def mean_ms(us: Column) -> Column:
    """Mean of whole microseconds, in ms: sums stay whole, so the order of rows doesn't matter."""
    return ratio(F.sum(us), F.count(us) * 1000)


@dataclass(frozen=True)
class Metric:
    key: str
    unit: str
    lower_is_better: bool
    compute: Callable[[], Column]


class Registry:
    """Metrics in order of registration; a key is taken once."""

    def __init__(self):
        self._held: dict[str, Metric] = {}

    def register(self, metric: Metric) -> Metric:
        if metric.key in self._held:
            raise ValueError(f"metric {metric.key} exists")
        self._held[metric.key] = metric
        return metric

    def __iter__(self):
        return iter(self._held.values())

    def columns(self, keys: list[str] | None = None) -> list[Column]:
        return [m.compute().alias(m.key) for m in self if keys is None or m.key in keys]


ABS, SIGNED = (lambda: F.col("abs_us")), (lambda: F.col("signed_us"))


def pool_metrics(thresholds_ms: tuple[int, ...] = (10, 50, 100)) -> Registry:
    reg = Registry()
    reg.register(Metric("mae_ms", "ms", True, lambda: mean_ms(ABS())))
    reg.register(Metric("median_ms", "ms", True, lambda: r(F.percentile(ABS(), 0.5) / 1000)))
    reg.register(Metric("signed_ms", "ms", True, lambda: mean_ms(SIGNED())))
    for t in thresholds_ms:
        reg.register(Metric(f"ta_{t}ms", "fraction", False, lambda t=t: share(ABS() <= t * 1000)))
    reg.register(Metric("err_gt100_pct", "percent", True, lambda: share(ABS() > 100_000, 100.0)))
    return reg


def summary(errors: DataFrame, group: list[str], thresholds_ms: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    """Per group: n_boundaries, the pool metrics, onset and offset means."""
    edge = lambda e: mean_ms(F.when(F.col("edge") == e, ABS()))
    return errors.groupBy(*group).agg(
        F.count("*").alias("n_boundaries"), *pool_metrics(thresholds_ms).columns(), edge("onset").alias("onset_mae_ms"), edge("offset").alias("offset_mae_ms")
    )


def counted_summary(counts: DataFrame, group: list[str], thresholds_ms: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    """``summary`` from errors counted by size, any number of rows a size: abs_us, n, and of them n_onset and n_below (signed below 0)."""
    a, n = ABS(), F.col("n")
    total = lambda v: F.sum(F.when(a.isNotNull(), v))
    mean = lambda v, m: ratio(total(a * v), total(m) * 1000)
    part = lambda test, scale=1.0: ratio(total(test.cast("bigint") * n), total(n), scale)
    onset = F.col("n_onset")
    return counts.groupBy(*group).agg(
        F.sum(n).alias("n_boundaries"), mean(n, n).alias("mae_ms"), r(F.percentile(a, 0.5, n) / 1000).alias("median_ms"), mean(n - 2 * F.col("n_below"), n).alias("signed_ms"),
        *[part(a <= t * 1000).alias(f"ta_{t}ms") for t in thresholds_ms], part(a > 100_000, 100.0).alias("err_gt100_pct"), mean(onset, onset).alias("onset_mae_ms"), mean(n - onset, n - onset).alias("offset_mae_ms"),
    )


def counted_mean(counts: DataFrame, group: list[str], n: str, name: str) -> DataFrame:
    """Per group the sum of ``n``, rows that stand for that many errors, and their mean error as ``name``."""
    timed = F.when(ABS().isNotNull(), F.col(n))
    return counts.groupBy(*group).agg(F.sum(n).alias(n), ratio(F.sum(ABS() * timed), F.sum(timed) * 1000).alias(name))


def per_type(errors: DataFrame, group: list[str], primary_ms: int = 25, least: int = LEAST) -> DataFrame:
    """Per group and (left_class, right_class): n, mae_ms, ta, underpowered."""
    one = lambda test: test.cast("bigint")
    counts = {"n": F.lit(1), "n_timed": one(ABS().isNotNull()), "n_within": one(ABS() <= primary_ms * 1000)}
    return type_rates(errors.withColumns(counts), group, least)


def type_rates(counts: DataFrame, group: list[str], least: int = LEAST) -> DataFrame:
    """The same from errors counted by type, any number of rows a type: n, n_timed (those that have an error), n_within (of them at most the primary threshold), abs_us (their sum)."""
    total = lambda c: F.sum(c).cast("bigint")
    return counts.groupBy(*group, "left_class", "right_class").agg(
        total("n").alias("n"), ratio(total("abs_us"), total("n_timed") * 1000).alias("mae_ms"), ratio(total("n_within"), total("n_timed")).alias("ta"), (total("n") < least).alias("underpowered")
    )


def edit_rates(counts: DataFrame, group: list[str]) -> DataFrame:
    """Summed counters and their ratios: recall, insertion rate, S/D/I and error rate in percent."""
    sums = ["n_gold", "n_hyp", "n_matched", "n_sub", "n_del", "n_ins"]
    out = counts.groupBy(*group).agg(F.count("*").alias("n_utts"), F.countDistinct("speaker_id").alias("n_speakers"), *[F.sum(c).cast("bigint").alias(c) for c in sums])
    return out.select(
        "*", ratio("n_matched", "n_gold").alias("arr"), ratio(F.col("n_hyp") - F.col("n_matched"), F.col("n_hyp")).alias("insert_rate"),
        *[ratio(f"n_{k}", "n_gold", 100.0).alias(f"{k}_pct") for k in ("sub", "del", "ins")],
        ratio(F.col("n_sub") + F.col("n_del") + F.col("n_ins"), F.col("n_gold"), 100.0).alias("per"),
    )


def detection(counts: DataFrame, group: list[str], prefix: str = "bnd") -> DataFrame:
    """Boundary detection from summed counters: precision, recall, f1, over-segmentation and R-value."""
    s = counts.groupBy(*group).agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n_gold_bnd", "n_hyp_bnd", "n_hits")])
    p, rec = F.col("n_hits") / F.when(F.col("n_hyp_bnd") > 0, F.col("n_hyp_bnd")), F.col("n_hits") / F.when(F.col("n_gold_bnd") > 0, F.col("n_gold_bnd"))
    some = (F.col("n_gold_bnd") > 0) | (F.col("n_hyp_bnd") > 0)
    f1 = F.when(some, F.when((p > 0) & (rec > 0), 2 * p * rec / (p + rec)).otherwise(0.0))
    os = F.when(F.col("n_gold_bnd") > 0, F.col("n_hyp_bnd") / F.col("n_gold_bnd") - 1)
    r1, r2 = F.sqrt(F.pow(1 - rec, 2) + F.pow(os, 2)), (rec - 1 - os) / F.sqrt(F.lit(2.0))
    value = 1 - (F.abs(r1) + F.abs(r2)) / 2
    return s.select(
        *group, F.col("n_gold_bnd").alias(f"n_{prefix}_gold"), F.col("n_hyp_bnd").alias(f"n_{prefix}_hyp"), "n_hits", r(p).alias(f"{prefix}_precision"), r(rec).alias(f"{prefix}_recall"),
        r(f1).alias(f"{prefix}_f1"), r(os).alias(f"{prefix}_os"), r(value).alias("r_value"),
    )


def rows(n: str | None) -> Column:
    """Number of rows; where each stands for as many as its column ``n`` says, their sum."""
    return F.sum(n) if n else F.count("*")


def by_value(errors: DataFrame, group: list[str], value: str, n: str | None = None) -> DataFrame:
    """Counts per distinct value with the tie-averaged rank of each: ranks and quantiles then run over distinct values, never over raw rows.

    Values are ranked within ranges, and ranges by their sums, so no window spans a group. The ranges' bounds are approximate quantiles; the ranks are exact whatever they are.
    """
    c = errors.groupBy(*group, value).agg(rows(n).alias("c"))
    bounds = c.groupBy(*group).agg(F.percentile_approx(value, [k / 32 for k in range(1, 32)], 1000).alias("_bounds"))
    c = c.join(bounds, group).withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= F.col(value)))).drop("_bounds")
    ranges = c.groupBy(*group, "_range").agg(F.sum("c").alias("_s"))  # at most 32 rows a group
    upto = F.sum("_s").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    c = c.join(ranges.select(*group, "_range", F.coalesce(upto, F.lit(0)).alias("_upto")), [*group, "_range"])
    before = F.sum("c").over(Window.partitionBy(*group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return c.select(*group, value, "c", (F.col("_upto") + F.coalesce(before, F.lit(0)) + (F.col("c") + 1) / 2).alias("rank"))


def usable_conf(errors: DataFrame) -> DataFrame:
    return errors.where(F.col("conf").isNotNull() & ~F.isnan("conf"))


def spearman(errors: DataFrame, group: list[str], n: str | None = None) -> DataFrame:
    """Rank correlation of confidence with -abs error; null below 3 rows or where a side is constant. ``n``, here and below: see ``rows``."""
    e = usable_conf(errors)
    a = by_value(e, group, "conf", n).select(*group, "conf", F.col("rank").alias("rc"))
    b = by_value(e, group, "abs_us", n).select(*group, "abs_us", F.col("rank").alias("ra"))
    pairs = e.groupBy(*group, "conf", "abs_us").agg(rows(n).alias("c")).join(a, [*group, "conf"]).join(b, [*group, "abs_us"])
    # twice the ranks are whole numbers, so their moments are exact
    x, y, c = (2 * F.col("rc")).cast("decimal(38,0)"), (-2 * F.col("ra")).cast("decimal(38,0)"), F.col("c")
    m = pairs.groupBy(*group).agg(F.sum(c).alias("n"), *[F.sum(v * c).cast("double").alias(k) for k, v in (("x", x), ("y", y), ("xx", x * x), ("yy", y * y), ("xy", x * y))])
    vx, vy = F.col("n") * F.col("xx") - F.col("x") * F.col("x"), F.col("n") * F.col("yy") - F.col("y") * F.col("y")
    ok = (F.col("n") >= 3) & (vx > 0) & (vy > 0)
    return m.select(*group, F.when(ok, F.round((F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(vx) / F.sqrt(vy), 6)).alias("spearman"))


def auroc(errors: DataFrame, group: list[str], tol_ms: int = 25, n: str | None = None) -> DataFrame:
    """Chance that a boundary within ``tol_ms`` has a higher confidence than one beyond it, ties half; null where a class is empty."""
    e = usable_conf(errors)
    ranks = by_value(e, group, "conf", n).select(*group, "conf", "rank")  # as Spearman's: planned together they're made once
    e = e.withColumn("good", (F.col("abs_us") <= tol_ms * 1000).cast("bigint") * (F.col(n) if n else F.lit(1)))
    pos = e.groupBy(*group, "conf").agg(F.sum("good").alias("p"), rows(n).alias("c")).join(ranks, [*group, "conf"])
    s = pos.groupBy(*group).agg(F.sum(F.col("p") * F.col("rank")).alias("w"), F.sum("p").alias("np"), (F.sum("c") - F.sum("p")).alias("nn"))
    return s.select(*group, r(F.when((F.col("np") > 0) & (F.col("nn") > 0), (F.col("w") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn")))).alias("auroc"))


def ece(errors: DataFrame, group: list[str], tol_ms: int = 25, bins: int = 10, n: str | None = None) -> DataFrame:
    """Expected calibration error over equal bins; null if a confidence lies outside [0, 1]. Adds n_conf."""
    e = usable_conf(errors)
    edges = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    e = e.withColumn("bin", F.size(F.filter(edges, lambda x: x <= F.col("conf"))))
    each = F.col(n) if n else F.lit(1)
    good = (F.col("abs_us") <= tol_ms * 1000).cast("bigint") * each
    milli = F.round(F.col("conf") * 1e6).cast("bigint") * each  # whole millionths: exact sums
    b = e.groupBy(*group, "bin").agg(rows(n).alias("c"), F.sum(good).alias("g"), F.sum(milli).alias("m"), F.max((F.col("conf") < 0) | (F.col("conf") > 1)).alias("odd"))
    gap = F.abs(F.col("g") * 1_000_000 - F.col("m"))
    return b.groupBy(*group).agg(F.sum("c").alias("n_conf"), F.when(~F.max("odd"), r(F.sum(gap) / 1e6 / F.sum("c"))).alias("ece"))


def tail(errors: DataFrame, group: list[str]) -> DataFrame:
    """n, mean, median, upper percentiles, maximum and shares of absolute errors, in ms and percent. Percentiles run over counted distinct values."""
    c = errors.groupBy(*group, "abs_us").agg(F.count("*").alias("c"))
    pct = lambda q: r(F.percentile("abs_us", q, F.col("c")) / 1000)
    part = lambda t: ratio(F.sum(F.when(t, F.col("c")).otherwise(0)), F.sum("c"), 100.0)
    a = F.col("abs_us")
    return c.groupBy(*group).agg(
        F.sum("c").alias("n"), ratio(F.sum(a * F.col("c")), F.sum("c") * 1000).alias("mae"), pct(0.5).alias("median"), *[pct(q / 100).alias(f"p{q}") for q in (75, 90, 95, 99)],
        r(F.max(a) / 1000).alias("max"), *[part(a <= t * 1000).alias(f"ta{t}") for t in (10, 25, 50)], *[part(a > t * 1000).alias(f"pct_gt{t}") for t in (50, 100, 200)],
    )


BUCKETS_MS = ((None, 10), (10, 25), (25, 50), (50, 100), (100, None))


def decomposition(errors: DataFrame, group: list[str]) -> DataFrame:
    """The mean's parts by (lo, hi] buckets of absolute error, long: group, bucket, pct, contrib_ms. The parts sum to the mean; the first bucket holds 0."""
    names = ["le10", "10_25", "25_50", "50_100", "gt100"]
    a = F.col("abs_us")
    inside = [(F.lit(True) if lo is None else a > lo * 1000) & (F.lit(True) if hi is None else a <= hi * 1000) for lo, hi in BUCKETS_MS]
    sums = [x for n, t in zip(names, inside, strict=True) for x in (F.sum(t.cast("bigint")).alias(f"c_{n}"), F.sum(F.when(t, a).otherwise(0)).alias(f"s_{n}"))]
    wide = errors.groupBy(*group).agg(F.count("*").alias("n"), *sums)
    stack = ", ".join(f"'{n}', c_{n}, s_{n}" for n in names)
    long = wide.selectExpr(*group, "n", f"stack({len(names)}, {stack}) as (bucket, c, s)")
    return long.select(*group, "bucket", ratio("c", "n", 100.0).alias("pct"), ratio(F.col("s"), F.col("n") * 1000).alias("contrib_ms"))


def edge_split(errors: DataFrame, group: list[str]) -> DataFrame:
    """Interior against silence-adjacent boundaries: counts, means, share at the edge."""
    s = F.col("silence_adjacent")
    return errors.groupBy(*group).agg(
        F.sum((~s).cast("bigint")).alias("n_interior"), F.sum(s.cast("bigint")).alias("n_edge"), mean_ms(F.when(~s, ABS())).alias("interior_mae"), mean_ms(F.when(s, ABS())).alias("edge_mae"), share(s, 100.0).alias("pct_edge")
    )


def numbered(rows: DataFrame, group: list[str], name: str, hash32: Callable[[Column], Column], seed: int = 0, parts: int = 64) -> DataFrame:
    """Adds u, a number from 0 within each group, in order of a hash of ``name``.

    Rows are counted within ``parts`` hash ranges and shifted by the counts of the ranges before, so no window spans a group.
    """
    p = rows.withColumn("_h", hash32(F.concat(F.lit(f"u:{seed}:"), F.col(name)))).withColumn("_part", F.floor(F.col("_h") * parts / 2**32).cast("int"))
    counts = p.groupBy(*group, "_part").agg(F.count("*").alias("_n"))  # at most ``parts`` rows a group
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*group, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    p = p.withColumn("u", F.row_number().over(Window.partitionBy(*group, "_part").orderBy("_h", name)) - 1)
    return p.join(counts, [*group, "_part"]).withColumn("u", F.col("u") + F.col("_before")).drop("_h", "_part", "_before")


def bootstrap(per_utt: DataFrame, group: list[str], replicates: int = 1000, seed: int = 0, more: dict[str, tuple[str, float]] | None = None, exact: bool = False) -> DataFrame:
    """95 % interval of a pooled mean over utterances: ``per_utt(group, utt_id, s, c)`` -> group, lo, hi (of sum s / sum c, per 1000).

    ``more`` gives further means over the same draws: name -> (column of ``per_utt``, divisor), as name_lo and name_hi of sum column / sum c / divisor.
    An utterance's weight in a replicate is a Poisson draw of mean 1 by hash, so that each row makes its own draws and nothing is numbered or joined; with ``exact`` the weights
    are those of n draws of n utterances, dealt down a tree of ranges. Either way a task adds up whole replicates before the shuffle.
    """
    stats = {"": ("s", 1000)} | {f"{k}_": v for k, v in (more or {}).items()}
    columns = [*dict.fromkeys([v for v, _ in stats.values()] + ["c"])]
    # few rows become very many draws: spread them over a stated number of partitions that adaptive execution leaves alone
    # by utterance alone: groups that share one come together and share its draws
    rows = per_utt.repartition(int(per_utt.sparkSession.conf.get("spark.sql.shuffle.partitions")), "utt_id")
    sums = (exact_sums if exact else poisson_sums)(rows, group, columns, replicates, seed)
    edge = lambda v, by, q: r(F.percentile(F.when(F.col("c") > 0, F.col(v) / F.col("c") / by), q))
    return sums.groupBy(*group).agg(*[edge(v, by, q).alias(f"{name}{end}") for name, (v, by) in stats.items() for end, q in (("lo", 0.025), ("hi", 0.975))])
