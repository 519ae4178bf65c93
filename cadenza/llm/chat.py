"""Chat formatting by a grammar round trip, in DataFrame functions only.

A turn is rendered as ``[INST]role[/INST]text</s>``. The parser is deterministic and strict: between two turn openings there must be exactly
one header end and one turn end, the latter at the very end, and the escapes ``\\0 \\1 \\2`` always stand for ``\\``, ``[`` and ``<``. Each turn
is rendered plainly, parsed again and compared with its source; only where the two differ is its content escaped and the result parsed
again. The whole conversation is parsed once more and the job fails if it does not give back the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, HEADER_END, TURN_END = "[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    """Reversible, and its result holds no character that could begin a control string."""
    for plain, coded in (("\\", "\\0"), ("[", "\\1"), ("<", "\\2")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in (("<", "\\2"), ("[", "\\1"), ("\\", "\\0")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(HEADER_END), text, F.lit(TURN_END))


def _parse_turn(body: Column) -> Column:
    """What stands between two turn openings -> struct(role, text, raw_role, raw_text); null if the grammar doesn't hold."""
    parts = F.split(body, r"\[/INST\]", -1)
    tail = F.split(F.get(parts, F.lit(1)), "</s>", -1)
    good = (F.size(parts) == 2) & (F.size(tail) == 2) & (F.get(tail, F.lit(1)) == "")
    raw_role, raw_text = F.get(parts, F.lit(0)), F.get(tail, F.lit(0))
    return F.when(
        good,
        F.struct(unescape(raw_role).alias("role"), unescape(raw_text).alias("text"), raw_role.alias("raw_role"), raw_text.alias("raw_text")),
    )


def parse(formatted: Column) -> Column:
    """Formatted conversation -> array of turns; null elements where the grammar doesn't hold. What precedes the first opening is dropped."""
    bodies = F.split(formatted, r"\[INST\]", -1)
    return F.transform(F.slice(bodies, 2, F.size(bodies)), _parse_turn)


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> one row per conversation, as read back from its formatted text.

    Columns: conv_id, formatted string, turns array<struct<role, text, raw_role, raw_text>> (parsed from ``formatted``), loss_spans
    array<struct<start, end>> (code points of ``formatted``, end exclusive, in order), loss_text (what ``formatted`` holds under the spans, without escapes).

    Null text or role: empty. Rows of one conversation with equal (or null, first) ``turn`` go by role, then text; repeated rows stay repeated turns. A null
    conv_id is a conversation of its own. An empty table gives no rows. Other columns are ignored. One conversation becomes one string, so it has to
    fit in memory; conversations share nothing.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def holds(rendered: Column) -> Column:
        found = parse(rendered)
        first = F.get(found, F.lit(0))
        return F.coalesce((F.size(found) == 1) & (first["role"] == F.col("role")) & (first["text"] == F.col("text")), F.lit(False))

    plain, escaped = render(F.col("role"), F.col("text")), render(escape(F.col("role")), escape(F.col("text")))
    rows = rows.withColumn("piece", F.when(holds(plain), plain).otherwise(escaped))
    rows = rows.withColumn("content", F.when(F.col("piece") == plain, F.col("text")).otherwise(escape(F.col("text"))))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"pos": F.row_number().over(order), "end": (upto - len(TURN_END)).cast("long")})
    span = F.struct((F.col("end") - F.char_length("content")).alias("start"), "end")
    body_at = F.col("end") + len(TURN_END) - F.char_length("piece") + len(OPEN)
    rows = rows.select("conv_id", F.struct("pos", "role", "text", "piece", span.alias("span"), body_at.alias("body_at")).alias("made"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("made")).alias("source"))
    whole = whole.withColumn("formatted", F.array_join(F.col("source")["piece"], ""))
    whole = whole.withColumn("turns", parse(F.col("formatted")))
    same = (F.col("turns")["role"] == F.col("source")["role"]) & (F.col("turns")["text"] == F.col("source")["text"])
    broken = F.raise_error(F.lit("a conversation doesn't survive its round trip")).cast("string")
    whole = whole.withColumn("formatted", F.when(F.coalesce(same, F.lit(False)), F.col("formatted")).otherwise(broken))
    masked = F.filter("source", lambda t: t["role"].isin(*loss_roles))
    bodies = F.split("formatted", r"\[INST\]", -1)  # what follows each opening, so that spans are cut without counting from the conversation's start each time

    def under_mask(turn: Column, body: Column) -> Column:
        span = turn["span"]
        return F.when(turn["role"].isin(*loss_roles), unescape(F.substring(body, (span["start"] - turn["body_at"] + 1).cast("int"), (span["end"] - span["start"]).cast("int")))).otherwise("")

    return whole.select(
        "conv_id",
        "formatted",
        "turns",
        masked["span"].alias("loss_spans"),
        F.array_join(F.zip_with("source", F.slice(bodies, 2, F.size("source")), under_mask), "").alias("loss_text"),
    )
