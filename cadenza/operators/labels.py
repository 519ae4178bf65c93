"""Label normalisation: canonical symbols, prepared tiers, unmapped reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phones
from ..functions.phones import norm_key


def canonicalize(tier: DataFrame, label_map: DataFrame, source: str = "source") -> DataFrame:
    """Adds canonical and outcome (mapped, delete, unmapped). The exact key is tried first, then its lower-case form.

    ``label_map(source, key, canonical)`` is a dimension of a few hundred rows; a null canonical deletes on purpose. A constant ``source`` that no row has is
    the caller's error: see ``check_source``.
    """
    m = F.broadcast(label_map.select(F.col("source").alias("_s"), F.col("key").alias("_k"), F.col("canonical").alias("_c"), F.lit(True).alias("_hit")))
    low = F.broadcast(label_map.select(F.col("source").alias("_ls"), F.col("key").alias("_lk"), F.col("canonical").alias("_lc"), F.lit(True).alias("_lhit")))
    t = tier.withColumn("_key", norm_key(F.col("label"), F.col(source)))
    t = t.join(m, (t[source] == F.col("_s")) & (t["_key"] == F.col("_k")), "left")
    t = t.join(low, (t[source] == F.col("_ls")) & (F.lower(t["_key"]) == F.col("_lk")), "left")
    canonical = F.when(F.col("_hit"), F.col("_c")).when(F.col("_lhit"), F.col("_lc"))
    hit = F.coalesce("_hit", "_lhit", F.lit(False))
    outcome = F.when(~hit, "unmapped").when(canonical.isNull(), "delete").otherwise("mapped")
    return t.select(*tier.columns, canonical.alias("canonical"), outcome.alias("outcome"))


def check_source(source: str, accent: str = "us") -> str:
    if source not in phones.sources(accent):
        raise ValueError(f"unknown label source {source!r}; known: {', '.join(phones.sources(accent))}")
    return source


def prepare_tier(tier: DataFrame, key: list[str]) -> DataFrame:
    """Deleted labels leave, unmapped ones become tokens of their own (they count but never match), pos is counted anew."""
    t = tier.where("outcome <> 'delete'")
    t = t.withColumn("label", F.when(F.col("outcome") == "unmapped", F.concat(F.lit("UNMAPPED:"), F.col("pos").cast("string"))).otherwise(F.col("canonical")))
    return t.withColumn("pos", (F.row_number().over(Window.partitionBy(*key).orderBy("pos")) - 1).cast("int")).drop("canonical", "outcome")


def unmapped_report(tier: DataFrame, group: list[str], top: int = 15, limit: float = 0.01) -> DataFrame:
    """The ``top`` unmapped labels of each group with counts, the group's rate, and whether it passes ``limit``. Groups without any have no row."""
    totals = tier.groupBy(*group).agg(F.count("*").alias("n_all"), F.sum((F.col("outcome") == "unmapped").cast("bigint")).alias("n_unmapped"))
    by = tier.where("outcome = 'unmapped'").groupBy(*group, "label").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "label"))
    rate = F.col("n_unmapped") / F.col("n_all")
    return by.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, group).select(*group, "rank", "label", "n", F.round(rate, 9).alias("rate"), (rate <= limit).alias("ok"))


def inventory(tier: DataFrame, group: list[str]) -> DataFrame:
    return tier.groupBy(*group).agg(F.countDistinct("label").alias("n_labels"), F.count("*").alias("n"))


def categorize(pairs: DataFrame, categories: DataFrame) -> DataFrame:
    """``pairs(corpus, family, ref_label, test_label, ...)`` with ref_cat, test_cat and agree added.

    ``categories(side, family, label, category)`` is a dimension of a few hundred rows. Labels it doesn't have are unknown, and unknown never agrees; a mark for an
    utterance's edge is silence. A rhotic test label against a rhotic reference label takes the reference's category, whatever its own.
    """
    side = lambda s, c: F.broadcast(categories.where(F.col("side") == s).select(F.col("family").alias(f"_{c}f"), F.col("label").alias(f"_{c}l"), F.col("category").alias(f"_{c}")))
    t = pairs.join(side("ref", "r"), (F.col("corpus") == F.col("_rf")) & (F.col("ref_label") == F.col("_rl")), "left")
    t = t.join(side("test", "t"), (F.col("family") == F.col("_tf")) & (F.col("test_label") == F.col("_tl")), "left")
    ref = F.when(F.col("ref_label") == phones.EDGE, "silence").otherwise(F.coalesce("_r", F.lit(phones.UNKNOWN)))
    test = F.when(F.col("test_label") == phones.EDGE, "silence").otherwise(F.coalesce("_t", F.lit(phones.UNKNOWN)))
    rhotic = F.col("test_label").isin(*phones.RHOTIC_TEST) & F.col("ref_label").isin(*phones.RHOTIC_REFERENCE)
    t = t.withColumns({"ref_cat": ref, "test_cat": F.when(rhotic, ref).otherwise(test)})
    return t.select(*pairs.columns, "ref_cat", "test_cat", ((F.col("ref_cat") == F.col("test_cat")) & (F.col("ref_cat") != phones.UNKNOWN)).alias("agree"))


def read_mapping(files: DataFrame) -> DataFrame:
    """Mapping files(path, content) of ``label: reference`` lines -> path, label, refs array<string>.

    A value is one label, a list in brackets, or a list of ``- label`` lines below. Quotes around labels are taken off; comments and other lines are passed over.
    """
    bare = lambda x: F.regexp_replace(F.trim(x), r"""^['"](.*)['"]$""", "$1")
    ls = files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("line", "text")).where(~F.col("text").rlike(r"^\s*(#|$)"))
    head = F.regexp_extract("text", r"^([^\s-].*?):(\s|$)", 1)
    w = Window.partitionBy("path").orderBy("line")
    ls = ls.withColumn("label", F.last(F.when(head != "", bare(head)), ignorenulls=True).over(w))
    value = F.when(head != "", F.regexp_extract("text", r"^[^\s-].*?:\s*(.*)$", 1)).otherwise(F.regexp_extract("text", r"^\s*-\s+(.*)$", 1))
    inner = F.regexp_extract(F.trim(value), r"^\[(.*)\]$", 1)
    found = F.when(inner != "", F.split(inner, ",")).otherwise(F.array(value))
    refs = ls.where("label is not null").select("path", "label", "line", F.posexplode(found).alias("k", "ref")).select("path", "label", "line", "k", bare(F.col("ref")).alias("ref")).where("ref <> ''")
    return refs.groupBy("path", "label").agg(F.array_sort(F.collect_list(F.struct("line", "k", "ref")))["ref"].alias("refs"))
