"""Plans of noise mixing: which item takes which noise, where and how loud. All draws are hashes of ids, so a plan doesn't depend on partitioning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import numbered


def condition_matrix(spark, noise_types: list[str], snrs: list[int]) -> DataFrame:
    """condition, noise_type, snr_db: ``clean`` and every noise at every SNR."""
    rows = [("clean", None, None)] + [(f"{n}_snr{s}", n, float(s)) for n in noise_types for s in snrs]
    return spark.createDataFrame(rows, "condition string, noise_type string, snr_db double")


def items(utterances: DataFrame, conditions: DataFrame, seed: int) -> DataFrame:
    """Every utterance under every condition: item_id, utt_id, condition, noise_type, snr_db, seed (unsigned 64 bits as decimal). ``conditions`` is a parameter table."""
    i = utterances.crossJoin(F.broadcast(conditions)).withColumn("item_id", F.concat_ws("__", "utt_id", "condition"))
    digest = F.sha2(F.concat(F.lit(f"{seed}::"), F.col("item_id")), 256)
    return i.withColumn("seed", F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)"))


def split_pool(pool: DataFrame, name: str, hash32: Callable[[Column], Column], seed: int, parts: int = 64) -> DataFrame:
    """Disjoint halves of a pool by seeded hash order: adds half (train or eval) and idx within it, both from 0.

    Ranks are counted within hash ranges and shifted by the counts of the ranges before, so no window spans the whole pool.
    """
    p = pool.withColumn("_h", hash32(F.concat(F.lit(f"{seed}:"), F.col(name)))).withColumn("_part", F.floor(F.col("_h") * parts / 2**32).cast("int"))
    counts = p.groupBy("_part").agg(F.count("*").alias("_n"))  # at most ``parts`` rows
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("_total", F.sum("_n").over(Window.partitionBy()))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_h", name)) - 1
    p = p.withColumn("_rank", rank).join(F.broadcast(before), "_part").withColumn("_rank", F.col("_rank") + F.col("_before"))
    cut = F.floor(F.col("_total") / 2)
    half = F.when(F.col("_rank") < cut, "train").otherwise("eval")
    return p.select(*pool.columns, half.alias("half"), (F.col("_rank") - F.when(F.col("_rank") < cut, 0).otherwise(cut)).cast("bigint").alias("idx"))


def pick_sources(items: DataFrame, pool: DataFrame, hash32: Callable[[Column], Column], size: int) -> DataFrame:
    """One noise file an item and an offset in its slack: joins ``pool(idx, file, noise_us)`` of ``size`` files; adds file, offset_us, tiled."""
    i = items.withColumn("idx", hash32(F.concat(F.lit("src:"), F.col("item_id"))) % size)
    j = i.join(pool, "idx")
    slack = F.col("noise_us") - F.col("dur_us")
    offset = F.when(slack > 0, hash32(F.concat(F.lit("off:"), F.col("item_id"))) % (slack + 1)).otherwise(0)
    return j.withColumns({"offset_us": offset.cast("bigint"), "tiled": slack < 0}).drop("idx")


def pick_babble(items: DataFrame, talkers: DataFrame, hash32: Callable[[Column], Column], k: int, size: int) -> DataFrame:
    """``k`` distinct talkers an item: item_id, sources (joined by ``+``). ``talkers(idx, talker)`` numbers ``size`` of them from 0, ``k`` or more.

    The pool is cut into ``k`` slices and each gives one talker by hash, so an item costs ``k`` rows however large the pool is.
    """
    if size < k:
        raise ValueError(f"{k} distinct talkers out of {size}")
    d = items.select("item_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("n"))
    low, high = F.floor(F.col("n") * size / k), F.floor((F.col("n") + 1) * size / k)
    d = d.withColumn("idx", low + hash32(F.concat_ws(":", F.lit("bab"), "item_id", F.col("n").cast("string"))) % (high - low)).join(talkers, "idx")
    return d.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "talker")))["talker"], "+").alias("sources"))


def foreground_draws(items: DataFrame, pool: DataFrame, hash32: Callable[[Column], Column], size: int, interval_us: int, shortest_us: int) -> DataFrame:
    """Noises one after another, an interval between them, until the item is covered: item_id, n, file, at_us.

    ``shortest_us`` is the length of the pool's shortest noise: it bounds an item's draws, so that each is covered whatever its length.
    """
    most = F.ceil(F.col("dur_us") / F.lit(shortest_us + interval_us)).cast("int")
    d = items.where("dur_us > 0").select("item_id", "dur_us", F.explode(F.sequence(F.lit(0), most - 1)).alias("n"))
    d = d.withColumn("idx", hash32(F.concat(F.lit("fg:"), F.col("item_id"), F.lit(":"), F.col("n").cast("string"))) % size).join(pool, "idx")
    at = F.sum(F.col("noise_us") + interval_us).over(Window.partitionBy("item_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumn("at_us", F.coalesce(at, F.lit(0)).cast("bigint")).where("at_us < dur_us").select("item_id", "n", "file", "at_us")


def weighted_pick(items: DataFrame, choices: DataFrame, hash32: Callable[[Column], Column]) -> DataFrame:
    """One of ``choices(choice, weight int)`` an item, in proportion to the weights. Without a positive weight no item gets one.

    Choices take consecutive ranges of whole numbers, cut into as many buckets as there are choices; an item meets those of its bucket in an equi-join, two
    on average. ``choices`` is a catalogue: its running sum is one window.
    """
    c = choices.where("weight > 0").withColumn("hi", F.sum("weight").over(Window.orderBy("choice"))).withColumn("lo", F.col("hi") - F.col("weight"))
    whole = c.agg(F.sum("weight").alias("_total"), F.ceil(F.sum("weight") / F.count("*")).alias("_width"))  # one row
    c = c.crossJoin(F.broadcast(whole)).drop("_total")
    c = c.select("choice", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / F.col("_width")), F.floor((F.col("hi") - 1) / F.col("_width")))).alias("_bucket"))
    d = items.crossJoin(F.broadcast(whole)).withColumn("u", hash32(F.concat(F.lit("rir:"), F.col("item_id"))) % F.col("_total"))
    d = d.withColumn("_bucket", F.floor(F.col("u") / F.col("_width")))
    return d.join(c, "_bucket").where("u >= lo and u < hi").drop("u", "hi", "lo", "_bucket", "_total", "_width")


def smooth_probabilities(members: DataFrame, group: list[str], smoothing: float = 0.0, total: Column | float = 1.0) -> DataFrame:
    """Completes and normalises ``probability`` within each group so that it sums to ``total``.

    Members without one share what the others leave of 1 (nothing, if they leave none); the others move towards that share by ``smoothing``. A group whose
    probabilities are all zero gets nulls.
    """
    w = Window.partitionBy(*group)
    p, given = F.col("probability"), F.coalesce(F.sum("probability").over(w), F.lit(0.0))
    open_ = F.sum(F.col("probability").isNull().cast("bigint")).over(w)
    m = members.withColumn("_even", F.when((open_ > 0) & (given < 1), (1 - given) / open_).otherwise(0.0))
    m = m.withColumn("probability", F.coalesce((1 - smoothing) * p + smoothing * F.col("_even"), F.col("_even")))
    return m.withColumn("probability", F.try_divide(p, F.sum("probability").over(w)) * total).drop("_even")


def _of(values: list, at: Column) -> Column:
    """One of a few fixed values, by number modulo their count."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(at, F.lit(len(values))).cast("int"))


def _key(prefix: str, *parts: str) -> Column:
    return F.concat_ws(":", F.lit(prefix), *[F.col(p).cast("string") for p in parts])


def background_draws(items: DataFrame, pool: DataFrame, hash32: Callable[[Column], Column], size: int, counts: list[int], snrs: list[int]) -> DataFrame:
    """Noises under a whole item, as many as one of ``counts`` says, each at one of ``snrs``: item_id, n, file, at_us (0), snr_db. No draws: no rows."""
    many = _of(counts, hash32(_key("bgn", "item_id")))
    d = items.select("item_id", F.explode(F.when(many > 0, F.sequence(F.lit(0), many - 1))).alias("n"))
    d = d.withColumn("idx", hash32(_key("bg", "item_id", "n")) % size).join(pool, "idx")
    return d.select("item_id", "n", "file", F.lit(0).cast("bigint").alias("at_us"), _of(snrs, hash32(_key("bgs", "item_id", "n"))).alias("snr_db"))


def point_noises(items: DataFrame, pool: DataFrame, hash32: Callable[[Column], Column], size: int, per_minute: int, snrs: dict[str, list[int]], share: int = 100) -> DataFrame:
    """Point-source noises of ``items(item_id, dur_us)``: item_id, n, file, at_us, snr_db.

    ``share`` percent of the items that are long enough take between one and floor(per_minute * minutes) noises of ``pool(idx, file, kind)``, kind being
    foreground (from a random hundredth of a second on) or background (from 0, throughout). ``snrs`` of a kind take turns within an item, starting at a
    hashed one, so that no order over all items is needed.
    """
    most = F.floor(F.col("dur_us") * per_minute / 60_000_000)
    many = F.when((most >= 1) & (hash32(_key("ptp", "item_id")) % 100 < share), 1 + hash32(_key("ptn", "item_id")) % most)
    d = items.select("item_id", "dur_us", F.explode(F.when(many >= 1, F.sequence(F.lit(0), many.cast("int") - 1))).alias("n"))
    d = d.withColumn("idx", hash32(_key("pt", "item_id", "n")) % size).join(pool, "idx")
    turn = F.count("*").over(Window.partitionBy("item_id", "kind").orderBy("n")) - 1 + hash32(_key("ptt", "kind", "item_id"))
    front = F.col("kind") == "foreground"
    at = F.when(front, hash32(_key("pta", "item_id", "n")) % (F.floor(F.col("dur_us") / 10_000) + 1) * 10_000).otherwise(0)
    snr = F.when(front, _of(snrs["foreground"], turn)).otherwise(_of(snrs["background"], turn))
    return d.select("item_id", "n", "file", at.cast("bigint").alias("at_us"), snr.alias("snr_db"))


def levels_in_turn(draws: DataFrame, kinds: dict[str, list[int]], hash32: Callable[[Column], Column]) -> DataFrame:
    """``draws(item_id, n, kind, ...)`` with snr_db: the levels of a kind take turns over the draws of all items, in order of a hash of item and number, so that each comes equally often.

    Draws are numbered within ranges of the hash and shifted by the counts of the ranges before; no window spans a kind.
    """
    t = numbered(draws.withColumn("_name", _key("turn", "item_id", "n")), ["kind"], "_name", hash32).drop("_name")
    snr = F.coalesce(*[F.when(F.col("kind") == kind, _of(values, F.col("u"))) for kind, values in kinds.items()])
    return t.select(*draws.columns, snr.alias("snr_db"))


def isotropic_noises(items: DataFrame, noises: DataFrame, hash32: Callable[[Column], Column], snrs: list[int], share: int = 100) -> DataFrame:
    """A room's own noise under ``share`` percent of its ``items(item_id, room)``: item_id, file, at_us (0), snr_db.

    ``noises(room, file)`` holds the few recordings of each room; rooms without one add nothing. One join on room, which adaptive execution splits where
    a room is hot.
    """
    held = noises.groupBy("room").agg(F.array_sort(F.collect_set("file")).alias("_files"))
    d = items.where(hash32(_key("isp", "item_id")) % 100 < share).join(held, "room")
    file = F.get("_files", (hash32(_key("iso", "item_id")) % F.size("_files")).cast("int"))
    return d.select("item_id", file.alias("file"), F.lit(0).cast("bigint").alias("at_us"), _of(snrs, hash32(_key("iss", "item_id"))).alias("snr_db"))


def replicate(table: DataFrame, ids: list[str], copies: int, prefix: str, original: bool = False) -> DataFrame:
    """``copies`` copies of every row with ``<prefix><copy>-`` before each of its ids, and copy, from 1; with ``original`` also copy 0. No shuffle."""
    t = table.withColumn("copy", F.explode(F.sequence(F.lit(0 if original else 1), F.lit(copies)))) if original or copies > 0 else table.withColumn("copy", F.lit(0)).where("false")
    return t.withColumns({c: F.concat(F.lit(prefix), F.col("copy").cast("string"), F.lit("-"), F.col(c)) for c in ids})


def rekey(table: DataFrame, ids: list[str], prefix: str = "", suffix: str = "") -> DataFrame:
    """The same ids under a prefix and a suffix, in any side table; ``id -> original`` is ``rekey`` of a copy of the column."""
    mark = lambda text: [F.lit(text)] if text else []
    return table.withColumns({c: F.concat(*mark(prefix), F.col(c).cast("string"), *mark(suffix)) for c in ids})


#: Parameters of the conditions that add noise to whole corpora; values as they're given to the augmentation tools.
RECIPES = (
    ("reverb", "rooms", "smallroom:0.5,mediumroom:0.5"), ("reverb", "speech_probability", "1"), ("noise", "fg_interval_s", "1"), ("noise", "fg_snrs", "15:10:5:0"), ("music", "bg_snrs", "15:10:8:5"), ("music", "num_bg_noises", "1"),
    ("babble", "bg_snrs", "20:17:15:13"), ("babble", "num_bg_noises", "3:4:5:6:7"),
)


def recipes(spark) -> DataFrame:
    """kind, parameter, value: a row each; lists of values are joined by colons."""
    return spark.createDataFrame(list(RECIPES), "kind string, parameter string, value string")


def recipe_values(kind: str, parameter: str) -> list[int]:
    """A recipe's list of whole numbers."""
    return [int(v) for v in dict(((k, p), v) for k, p, v in RECIPES)[kind, parameter].split(":")]


def plan_table(items: DataFrame, sources: DataFrame, scales: DataFrame, media: Column) -> DataFrame:
    """The manifest of a mix, a row an item: item_id, utt_id, condition, noise_type, snr_db, noise_source_file, noise_offset_s, noise_scale, mixed_audio_path.

    ``items(item_id, utt_id, condition, noise_type, snr_db, path)``, ``sources(item_id, file, offset_us)``, ``scales(item_id, scale)``; clean items have neither. Offsets are
    rounded to six digits, scales to eight. Outputs lie below ``media``, a name for the folder the item's audio comes from, so that two roots never share one.
    """
    t = items.join(sources, "item_id", "left").join(scales, "item_id", "left")
    noisy = F.col("noise_type").isNotNull()
    path = F.concat_ws("/", media, "utt_id", F.concat(F.when(noisy, F.col("condition")).otherwise("clean"), F.lit(".wav")))
    return t.select(
        "item_id", "utt_id", "condition", "noise_type", "snr_db", F.when(noisy, F.col("file")).alias("noise_source_file"), F.when(noisy, F.round(F.col("offset_us") / 1e6, 6)).alias("noise_offset_s"),
        F.when(noisy, F.round("scale", 8)).alias("noise_scale"), path.alias("mixed_audio_path"),
    )
