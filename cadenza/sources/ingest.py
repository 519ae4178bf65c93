"""Readers of interval annotation, split lists, side tables and mixing commands; writers of results.

Text formats come in as files(path, content), one row a file (see ``read_whole``), so that parsing is plain DataFrame work over any source of text.
Schemas are always explicit.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import results

INTERVALS = "array<struct<label:string,start_us:bigint,end_us:bigint,conf:double>>"
HYP = f"item_id string, utt_id string, condition string, aligner string, mode string, source string, rtf double, words {INTERVALS}, phones {INTERVALS}"
# fixed value: the order of the parts of a cell's path
CELL = ["kind", "tool", "lang", "corpus", "subset", "cell_condition"]
# fixed value: names of corpora whose annotation is machine-made; callers may add to them, never take away
MACHINE_ALIGNED = ("librispeech-alignments", "libritts", "libritts-r", "common-voice-alignments", "commonvoice", "cmu-arctic", "mfa-aligned")


def read_json(spark: SparkSession, path: str, schema: str = HYP) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, broken ones kept in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """files(path, content) of every file below ``path``."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes of files; contents are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def cell_key(path: Column) -> list[Column]:
    """The six parts of a cell from ``…/<kind>/<tool>/<lang>/<corpus>/<subset>/<condition>/<file>``, as columns."""
    return [F.regexp_extract(path, "/" + "/".join(["([^/]+)"] * 6) + "/[^/]+$", i + 1).alias(c) for i, c in enumerate(CELL)]


def list_cells(spark: SparkSession, path: str) -> DataFrame:
    """Every cell below ``path`` that has files, with n_files: found by listing, contents are never read. Folders may be named ``<part>`` or ``<column>=<part>``."""
    bare = [F.regexp_replace(c, rf"^{n}=", "").alias(n) for c, n in zip(cell_key(F.col("path")), CELL, strict=True)]
    return listing(spark, path).where(~F.col("path").rlike("/[._][^/]*$")).select(*bare).groupBy(*CELL).agg(F.count("*").alias("n_files"))


def read_cells(spark: SparkSession, path: str, schema: str = HYP) -> DataFrame:
    """The items of all cells below ``path`` (folders named ``<column>=<part>``) with the cell's parts as columns; a filter on those skips the other folders."""
    parts = ", ".join(f"{c} string" for c in CELL)
    return read_json(spark, path, f"{schema}, {parts}")


def read_speakers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table; lines that begin with ``#`` are comments."""
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path)


def lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("line", "text"))


def path_id(path: Column, parts: int) -> Column:
    """An utterance's id from the last ``parts`` parts of its path, the extension left off, joined by ``_``."""
    p = F.split(F.regexp_replace(path, r"\.[^./]*$", ""), "/")
    return F.array_join(F.slice(p, F.greatest(F.lit(1), F.size(p) - parts + 1), parts), "_")


def word_tiers(files: DataFrame, rate: int, parts: int = 2) -> DataFrame:
    """As sample_tiers, for words: labels in lower case, and utt_id from the path."""
    return sample_tiers(files, rate).withColumns({"label": F.lower("label"), "utt_id": path_id(F.col("path"), parts)})


def sample_tiers(files: DataFrame, rate: int) -> DataFrame:
    """``start end label…`` in samples, a row a line; the label is the rest of the line. Lines with fewer parts or other numbers are dropped. File order gives pos."""
    p = lines(files).withColumn("p", F.split(F.trim("text"), r"\s+", 3)).where(F.size("p") == 3)
    us = lambda i: F.round(F.get("p", F.lit(i)).try_cast("bigint") * 1_000_000 / rate).cast("bigint")
    t = p.select("path", "line", us(0).alias("start_us"), us(1).alias("end_us"), F.get("p", F.lit(2)).alias("label")).where("start_us is not null and end_us is not null")
    return _numbered(t)


def cumulative_tiers(files: DataFrame) -> DataFrame:
    """``end color label; …`` in seconds after a header that ends at the line ``#``. An interval starts where the last parsed one ended (0 at first).

    The label is the text before the first ``;``; a line with nothing there takes its code field. Lines whose time can't be parsed are skipped. Adds fields, the parts after the label.
    """
    ls = lines(files)
    head = ls.where(F.trim("text") == "#").groupBy("path").agg(F.min("line").alias("head"))
    p = ls.join(head, "path").where("line > head").withColumn("p", F.split(F.trim("text"), r"\s+", 3))
    end = F.round(F.get("p", F.lit(0)).try_cast("double") * 1_000_000).cast("bigint")
    rest = F.split(F.coalesce(F.get("p", F.lit(2)), F.lit("")), ";")
    t = p.select("path", "line", end.alias("end_us"), F.trim(F.get(rest, F.lit(0))).alias("label"), F.get("p", F.lit(1)).alias("code"), F.transform(F.slice(rest, 2, F.size(rest)), lambda x: F.trim(x)).alias("fields"))
    t = t.where("end_us is not null").withColumn("label", F.when(F.col("label") == "", F.col("code")).otherwise(F.col("label")))
    start = F.lag("end_us", 1, 0).over(Window.partitionBy("path").orderBy("line"))
    return _numbered(t.withColumn("start_us", start)).drop("code")


def _numbered(t: DataFrame) -> DataFrame:
    return t.withColumn("pos", (F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1).cast("int")).drop("line")


def word_pronunciations(tier: DataFrame) -> DataFrame:
    """Of tiers with fields (canonical; realised; …): path, pos, word, canonical, realised, is_canonical. Markers (``<…``) and unknowns (``U``) are dropped."""
    t = tier.where((F.size("fields") >= 2) & ~F.startswith("label", F.lit("<")) & ~F.startswith("label", F.lit("{")))
    spoken = lambda i: F.split(F.trim(F.get("fields", F.lit(i))), r"\s+")
    t = t.select("path", "pos", F.col("label").alias("word"), spoken(0).alias("canonical"), spoken(1).alias("realised"))
    odd = lambda c: (F.get(c, F.lit(0)) == "") | F.array_contains(c, "U")
    return t.where(~odd("canonical") & ~odd("realised")).withColumn("is_canonical", F.col("canonical") == F.col("realised"))


def textgrids(files: DataFrame) -> DataFrame:
    """Interval tiers of long-form TextGrids: path, tier (lower case), pos, label, start_us, end_us. Empty labels are ``sil``, doubled quotes single; of error-coded ``a,b,c`` the first stays; words are lower-cased."""
    tiers = files.select("path", F.explode(F.slice(F.split("content", r"item \[\d+\]:"), 2, F.size(F.split("content", r"item \[\d+\]:")))).alias("body")).where(F.contains("body", F.lit('"IntervalTier"')))
    name = F.lower(F.regexp_extract("body", r'name = "([^"]*)"', 1))
    pattern = r'intervals \[\d+\]:\s*xmin = ([-0-9.eE]+)\s*xmax = ([-0-9.eE]+)\s*text = "((?:[^"]|"")*)"'
    found = F.arrays_zip(*[F.regexp_extract_all("body", F.lit(pattern), i).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "t"))])
    t = tiers.select("path", name.alias("tier"), F.posexplode(found).alias("pos", "x"))
    us = lambda c: F.round(F.col(c).cast("double") * 1_000_000).cast("bigint")
    label = F.trim(F.get(F.split(F.replace(F.col("x.t"), F.lit('""'), F.lit('"')), ","), F.lit(0)))
    label = F.when(label == "", "sil").when(F.col("tier") == "words", F.lower(label)).otherwise(label)
    return t.select("path", "tier", "pos", label.alias("label"), us("x.a").alias("start_us"), us("x.b").alias("end_us"))


def split_list(text: DataFrame) -> DataFrame:
    """``<speaker> <utterance>`` lines of text(value), ``#`` starts a comment: speaker_id, utt_id."""
    p = F.split(F.trim("value"), r"\s+")
    return text.where(~F.startswith(F.trim("value"), F.lit("#")) & (F.size(p) >= 2)).select(F.get(p, F.lit(0)).alias("speaker_id"), F.get(p, F.lit(1)).alias("utt_id"))


def apply_split(df: DataFrame, split: DataFrame, by: str = "utt_id") -> DataFrame:
    return df.join(split.select(by).distinct(), by, "left_semi")


def exclude_prompts(df: DataFrame, pattern: str, column: str = "utt_id") -> DataFrame:
    return df.where(~F.col(column).rlike(pattern))


def key_values(text: DataFrame) -> DataFrame:
    """Two columns of ``key rest-of-line`` text(value)."""
    p = F.split(F.trim("value"), r"\s+", 2)
    return text.where(F.size(p) == 2).select(F.get(p, F.lit(0)).alias("key"), F.get(p, F.lit(1)).alias("value"))


def shell_words(command: Column) -> Column:
    """A command's words: quotes hold blanks together."""
    return F.regexp_extract_all(command, F.lit(r"""(?:[^\s'"]|'[^']*'|"[^"]*")+"""), 0)


def unquoted(word: Column) -> Column:
    return F.regexp_replace(word, r"""^(['"])(.*)\1$""", "$2")


def mix_commands(text: DataFrame) -> DataFrame:
    """Mixing commands (text(value): id, then a shell command): key, snrs, noises, start_times, rir. What a command doesn't say is empty, the response null.

    A command is shell words: quotes hold blanks together, and ``--option=value`` is one word. Signals in a list may be commands of their own; a signal's file is its
    first word that ends in ``.wav``.
    """
    kv = key_values(text).withColumn("_words", shell_words(F.col("value")))

    def option(name):
        word = F.get(F.filter("_words", lambda w: F.startswith(w, F.lit(f"--{name}="))), F.lit(0))
        return F.coalesce(unquoted(F.substr(word, F.lit(len(name) + 4))), F.lit(""))

    def file(signal):
        words = F.transform(F.regexp_extract_all(signal, F.lit(r'"[^"]*"|\S+'), 0), lambda w: F.replace(w, F.lit('"'), F.lit("")))
        return F.get(F.filter(words, lambda w: F.endswith(w, F.lit(".wav"))), F.lit(0))

    listed = lambda name: F.filter(F.transform(F.split(option(name), ","), lambda x: F.trim(x)), lambda x: x != "")
    numbers = lambda name: F.transform(listed(name), lambda x: x.cast("double"))
    noises = F.filter(F.transform(listed("additive-signals"), file), lambda x: x.isNotNull())
    return kv.select("key", numbers("snrs").alias("snrs"), noises.alias("noises"), numbers("start-times").alias("start_times"), file(option("impulse-response")).alias("rir"))


def padded_durations(commands: DataFrame, media: DataFrame) -> DataFrame:
    """Length of what each of text(value: id, then a path or a command) gives: that of ``media(path, dur_us)`` and what the command's filters add: key, dur_us (null without a medium).

    The medium is the word after ``-i``, or all of a command without one, but for a last ``|``. Filters are a word of ``name=value`` items joined by ``,``, values of one filter by ``:``; a
    delay is in ms (that of the first channel), a padding in seconds.
    """
    kv = key_values(commands).withColumn("_words", shell_words(F.col("value")))
    at = F.array_position("_words", "-i").cast("int")  # counted from 1, 0: there is none
    bare = F.trim(F.rtrim(F.col("value"), F.lit("| ")))
    path = unquoted(F.when(at > 0, F.get("_words", at)).otherwise(bare))
    items = F.flatten(F.transform("_words", lambda w: F.transform(F.split(unquoted(w), "[,:]"), lambda x: F.reverse(F.split(x, "=")))))  # value, name, filter

    def added(name, per):
        value = F.get(F.get(F.filter(items, lambda x: F.get(x, F.lit(1)) == name), F.lit(0)), F.lit(0))
        return F.coalesce(F.round(F.substring_index(value, "|", 1).try_cast("double") * per).cast("bigint"), F.lit(0))

    delay, padding = added("adelay", 1000), added("pad_dur", 1_000_000)
    t = kv.select("key", path.alias("path"), (delay + padding).alias("_more"))
    return t.join(media, "path", "left").select("key", (F.col("dur_us") + F.col("_more")).alias("dur_us"))


def noise_catalog(files: DataFrame, notes: DataFrame) -> DataFrame:
    """Noise files(path: …/<kind>/<name>.wav) by name: kind, vocals and missing.

    ``notes(value)`` are lines about music: a name, anything, and at the end whether there are vocals (Y or N). A file without a note has null vocals; a note without a
    file is missing music.
    """
    f = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("kind"), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name"), "path")
    p = F.split(F.trim("value"), r"\s+")
    n = notes.where(F.size(p) >= 2).select(F.get(p, F.lit(0)).alias("name"), (F.element_at(p, -1) == "Y").alias("vocals"))
    return f.join(n, "name", "full").select("name", F.coalesce("kind", F.lit("music")).alias("kind"), "path", "vocals", F.col("path").isNull().alias("missing"))


def resolve_media(utts: DataFrame, files: DataFrame, priority: tuple[str, ...] = ("wav", "flac", "sph")) -> DataFrame:
    """One file an utterance by extension, first in ``priority``: utts with path (null if none). ``files(path)`` are named ``<utt_id>.<ext>``."""
    f = files.select("path", F.regexp_extract("path", r"([^/]+)\.([A-Za-z0-9]+)$", 1).alias("utt_id"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"))
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("ext"))
    best = f.withColumn("rank", rank).where("rank > 0").groupBy("utt_id").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return utts.join(best, "utt_id", "left")


def layout_probe(files: DataFrame, probes: list[tuple[str, int]]) -> DataFrame:
    """How many files fit each pattern, against a minimum: pattern, n, least, ok. Probes are a short list, all counted in one pass."""
    sums = files.agg(*[F.coalesce(F.sum(F.col("path").rlike(p).cast("bigint")), F.lit(0)).alias(f"n{k}") for k, (p, _) in enumerate(probes)])
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"n{k}").alias("n"), F.lit(least).alias("least")) for k, (p, least) in enumerate(probes)])
    return sums.select(F.explode(rows).alias("p")).select("p.*").withColumn("ok", F.col("n") >= F.col("least"))


def machine_aligned(path: Column, more: tuple[str, ...] = ()) -> Column:
    """The first name of the list that ``path`` contains, whatever the case and with ``_`` as ``-``; null if none."""
    plain = lambda x: x.lower().replace("_", "-")
    hay = F.replace(F.lower(path), F.lit("_"), F.lit("-"))
    return F.coalesce(*[F.when(F.contains(hay, F.lit(plain(n))), n) for n in dict.fromkeys((*MACHINE_ALIGNED, *more))])


def assert_gold_allowed(files: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """``files`` unchanged; raises if a path names a corpus whose annotation is machine-made."""
    bad = files.select("path", machine_aligned(F.col("path"), more).alias("name")).where("name is not null").take(1)
    if bad:
        raise ValueError(f"machine-aligned annotation can't be a reference: {bad[0]['path']} ({bad[0]['name']})")
    return files


def export_refs(tier: DataFrame, path: str, partition: list[str]) -> None:
    """Reference tiers as JSON lines, an utterance a line: utt_id and intervals(label, start, end) in seconds of six digits, by ``partition``. Utterances without intervals have none."""
    sec = lambda c: F.round(F.col(c) / 1_000_000, 6)
    one = F.struct("pos", F.struct("label", sec("start_us").alias("start"), sec("end_us").alias("end")).alias("x"))
    made = tier.groupBy(*partition, "utt_id").agg(F.array_sort(F.collect_list(one))["x"].alias("intervals"))
    export_tier(made, path, partition)


def export_tier(tier: DataFrame, path: str, partition: list[str]) -> None:
    """JSON lines, partitioned, in order of utterance within a file; a partition that is written again is replaced whole, others stay, and readers see all of it or nothing (``exported``)."""
    order = [c for c in ("utt_id", "pos") if c in tier.columns]
    rows = tier.repartition(*partition, F.pmod(F.xxhash64("utt_id"), F.lit(64))).sortWithinPartitions(*partition, *order)
    results.publish(tier.sparkSession, path, {"items": results.Part(rows, tuple(partition), "json")})


def exported(spark: SparkSession, path: str) -> DataFrame:
    """What ``export_tier`` wrote."""
    return results.current(spark, path).table("items")


def replace_table(table: DataFrame, path: str, form: str = "parquet", **options) -> None:
    """Write a new version beside the old ones, then name it in ``path``/CURRENT by one rename: readers see the old table or the new one, never half of either."""
    spark = table.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    table.write.options(**options).format(form).save(f"{path}/{version}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, named = (jvm.org.apache.hadoop.fs.Path(f"{path}/{n}") for n in (f"_{version}", "CURRENT"))
    out = new.getFileSystem(conf).create(new, True)
    out.write(bytearray(version, "utf-8"))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, named, over)


def current_table(spark: SparkSession, path: str, form: str = "parquet", **options) -> DataFrame:
    """What ``replace_table`` wrote last."""
    version = spark.read.text(f"{path}/CURRENT").first()[0]
    return spark.read.options(**options).format(form).load(f"{path}/{version}")


def write_results(table: DataFrame, per_type: DataFrame, path: str, keys: tuple[str, ...] = ("corpus", "system", "cond")) -> None:
    """The leaderboard as Parquet and CSV and the table by type as Parquet, rows in order of ``keys``, published as one: see ``results.current``."""
    ordered = table.orderBy(*keys)
    parts = {
        "leaderboard": results.Part(ordered), "leaderboard_csv": results.Part(ordered, form="csv", options={"header": "true"}),
        "per_type": results.Part(per_type.orderBy(*keys, "left_class", "right_class")),
    }
    results.publish(table.sparkSession, path, parts)


def variant_key(**parts) -> str:
    """A name for a result that changes with whatever changes the result: subset, protocol, options, the folder of the audio."""
    return hashlib.sha1(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def media_key(path: Column) -> Column:
    """A short name for the folder a medium lies in, so that two roots never share an output."""
    return F.concat(F.lit("a"), F.substring(F.sha1(F.regexp_replace(path, r"/[^/]*$", "")), 1, 8))


def first_items(tier: DataFrame, n: int, key: str = "utt_id") -> DataFrame:
    """The tiers of the first ``n`` items by name, for a trial run."""
    return tier.join(tier.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


def publish(table: DataFrame, path: str, month: str | None = None) -> None:
    """A dated snapshot (``month`` as YYYYMM; default: the current one), which takes the place of one of that month at once."""
    dated = table.withColumn("month", F.lit(month) if month else F.date_format(F.current_date(), "yyyyMM"))
    results.publish(table.sparkSession, path, {"snapshots": results.Part(dated, ("month",))})


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot: the month is found in partition values alone, and only its files are read."""
    t = results.current(spark, path).table("snapshots")
    newest = t.agg(F.max("month")).first()[0]
    return t.where(F.col("month") == newest)
