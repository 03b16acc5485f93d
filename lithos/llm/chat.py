"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and the others as named users; the loss mask is on for
the assistant's own words only. `rotate` gives a rendered dialogue as its messages,
a row for each; `dialogues` assembles them, in parts where a conversation is long,
with the ranges of the mask. Only SQL functions are used.

A speaker can't forge a turn: where a text or a name holds the beginning of a
marker, ``<|``, a backslash goes between the two characters (and one more if there
are some already, so that it can be undone); a name has no end of a marker and no
line breaks either.

Rows of a conversation meet its participants on the conversation and a salt, so
that no conversation is one task: those with more than a share of all rows, which
are few by that definition, are dealt over several salts.

Defined results. A null role speaks as ``unknown``; a null text is empty. A
speaker whose role is ``system`` is a participant like the others. Rows with a
null conversation form one conversation. Repeated rows are rendered one by one.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "|>"
END = "<|end|>\n"
#: A conversation with more than one in so many of all rows is dealt over salts.
HOT = 1000
#: Rows of a conversation that one salt takes, about, and its part of a dialogue.
SALT_ROWS, PART_ROWS = 10_000, 2_000


def escaped(text: Column) -> Column:
    """No beginning of a marker in it."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_name(name: Column) -> Column:
    """No beginning and no end of a marker, and one line."""
    return F.regexp_replace(F.regexp_replace(escaped(name), r"(\\*)\|>", r"\\$1|>"), r"[\r\n]", " ")


def _hot(rows: DataFrame) -> DataFrame:
    """``_hot_conv, salts`` of conversations with more than a ``HOT``-th of all
    rows: fewer than ``HOT``."""
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_total"))
    # One row beside the sizes.
    large = sizes.join(F.broadcast(total), (F.col("_n") * HOT > F.col("_total")) & (F.col("_n") > SALT_ROWS))
    return large.select(F.col("conv_id").alias("_hot_conv"), F.ceil(F.col("_n") / SALT_ROWS).cast("int").alias("salts"))


def rotate(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation, perspective and message: ``role`` and ``name``
    in that perspective, the ``rendered`` message, and the half-open range of its
    characters that is trained on (empty for the others)."""
    said = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"),
        escaped(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
    )
    hot = F.broadcast(_hot(said))  # fewer than HOT rows
    views = said.select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    views = views.join(hot, F.col("_conv").eqNullSafe(F.col("_hot_conv")), "left")
    views = views.select("_conv", "perspective", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("_view_salt"))
    said = said.join(hot, F.col("conv_id").eqNullSafe(F.col("_hot_conv")), "left")
    said = said.withColumn("_salt", F.pmod(F.xxhash64("turn", "speaker", "text"), F.coalesce("salts", F.lit(1))).cast("int"))
    own = F.col("speaker") == F.col("perspective")
    header = F.when(own, F.lit(f"{OPEN}assistant{CLOSE}\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), escaped_name(F.col("speaker")), F.lit(f"{CLOSE}\n")))
    out = said.join(views, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_salt") == F.col("_view_salt"))).withColumn("_header", header)
    begin = F.char_length("_header")
    return out.select(
        "conv_id",
        "perspective",
        "turn",
        F.when(own, F.lit("assistant")).otherwise(F.lit("user")).alias("role"),
        F.when(own, F.lit(None).cast("string")).otherwise(F.col("speaker")).alias("name"),
        F.concat("_header", "text", F.lit(END)).alias("rendered"),
        begin.cast("long").alias("mask_start"),
        F.when(own, begin + F.char_length("text") + F.lit(len(END) - 1)).otherwise(begin).cast("long").alias("mask_end"),
    )


def dialogues(messages: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The rows of `rotate` assembled: ``conv_id, perspective, part, first_turn,
    last_turn, n_messages, text`` and ``mask``, the half-open ranges of the text
    that are trained on.

    Messages go by turn (nulls first; rows of one turn by their rendering). A
    dialogue of more than ``part_rows`` messages comes in parts of consecutive
    turns, and where one range of turns alone holds more, that range in several."""
    key = ["conv_id", "perspective"]
    span = F.floor(F.coalesce("turn", F.lit(0)) / part_rows).cast("long")
    rows = messages.withColumn("_span", span)
    sizes = rows.groupBy(*key, "_span").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > part_rows)
    sizes = sizes.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("_span").alias("_s"), F.ceil(F.col("_n") / part_rows).alias("_cuts"))
    rows = rows.join(sizes, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & (F.col("_span") == F.col("_s")), "left")
    rows = rows.withColumn("_cut", F.pmod(F.xxhash64("turn", "rendered"), F.coalesce("_cuts", F.lit(1))))
    parts = rows.groupBy(*key, "_span", "_cut").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("at"), "rendered", "mask_start", "mask_end"))).alias("m"),
        F.min("turn").alias("first_turn"),
        F.max("turn").alias("last_turn"),
    )
    # The ranges, moved by what stands before each message.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("mask"))

    def add(acc: Column, x: Column) -> Column:
        moved = F.struct((acc["at"] + x["mask_start"]).alias("start"), (acc["at"] + x["mask_end"]).alias("end"))
        mask = F.when(x["mask_end"] > x["mask_start"], F.concat(acc["mask"], F.array(moved))).otherwise(acc["mask"])
        return F.struct((acc["at"] + F.char_length(x["rendered"])).alias("at"), mask.alias("mask"))

    return parts.select(
        *key,
        F.struct(F.col("_span").alias("span"), F.col("_cut").alias("cut")).alias("part"),
        "first_turn",
        "last_turn",
        F.size("m").alias("n_messages"),
        F.concat_ws("", F.transform("m", lambda x: x["rendered"])).alias("text"),
        F.aggregate("m", start, add, lambda acc: acc["mask"]).alias("mask"),
    )


ORACLE = r"""
WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text FROM conversations),
views AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said),
r AS (
  SELECT s.conv_id, v.perspective, s.turn, s.speaker, s.text, s.speaker = v.perspective AS own,
    CASE WHEN s.speaker = v.perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || regexp_replace(regexp_replace(regexp_replace(s.speaker, '<(\\*)\|', '<\\\1|', 'g'), '(\\*)\|>', '\\\1|>', 'g'), '[\r\n]', ' ', 'g') || '|>' || chr(10) END AS header
  FROM said s JOIN views v ON s.conv_id IS NOT DISTINCT FROM v.conv_id)
SELECT conv_id, perspective, turn, CASE WHEN own THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN own THEN NULL ELSE speaker END AS name, header || text || '<|end|>' || chr(10) AS rendered,
  CAST(length(header) AS BIGINT) AS mask_start,
  CAST(CASE WHEN own THEN length(header) + length(text) + 7 ELSE length(header) END AS BIGINT) AS mask_end
FROM r
"""
