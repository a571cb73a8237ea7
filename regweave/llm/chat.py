"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a conversation::

    conversation := turn*
    turn         := "<s>[INST]" role "[/INST]" text "</s>"

Inside roles and texts the four control strings must not occur. Escaping puts a
backslash after the opening bracket of each control string, and one more into
those that already have some, so it can be undone exactly. The parser is
deterministic: it cuts at the control strings and takes one backslash out of each
escaped one.

A part is first rendered as it is. It is parsed again, and only where the
recovered turns differ from the source is its content escaped and parsed once
more; a conversation that still differs is reported in ``exact``.

Edge cases: a null text or role is empty; rows of a null conversation form one
conversation; turns with equal numbers are ordered by role and text, null numbers
come first; repeated rows are separate turns; an empty table gives no rows; other
columns are ignored. One conversation is one text, so a row holds it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, _CONTROL, r"$1$2\\$3")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, "$1$2$3")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def parsed(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation; text outside the grammar gives a null turn."""
    # each turn ends with CLOSE, so the last piece is empty
    pieces = F.split(formatted, F.lit(r"\Q</s>\E"), -1)
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(x: Column) -> Column:
        halves = F.split(F.substring(x, len(OPEN) + 1, 1 << 30), F.lit(r"\Q[/INST]\E"), -1)
        fits = (x.startswith(OPEN) & (F.size(halves) == 2) & ~F.element_at(halves, 1).contains("<s>")
                & ~F.element_at(halves, 1).contains("[INST]") & ~F.element_at(halves, -1).contains("<s>")
                & ~F.element_at(halves, -1).contains("[INST]"))
        return F.when(fits, F.struct(unescaped(F.element_at(halves, 1)).alias("role"),
                                     unescaped(F.element_at(halves, -1)).alias("text")))

    out = F.transform(turns, turn)
    return F.when(F.element_at(pieces, -1) == "", out).otherwise(
        F.concat(out, F.array(F.lit(None).cast("struct<role:string,text:string>"))))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, turns, exact): the rendered text, the turns read back from it."""
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = F.struct(role.alias("role"), text.alias("text"))
    # round trip of each turn: escape only what conflicts
    turn = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), source.alias("source"),
                       rendered(role, text).alias("plain"), rendered(escaped(role), escaped(text)).alias("safe"))
    turn = turn.withColumn("part", F.when(parsed(F.col("plain")).eqNullSafe(F.array("source")), F.col("plain"))
                           .otherwise(F.col("safe")))
    conv = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "source", "part", "safe"))).alias("t"))
    conv = conv.select("conv_id", F.transform("t", lambda x: x["source"]).alias("source"),
                       F.array_join(F.transform("t", lambda x: x["part"]), "").alias("plain"),
                       F.array_join(F.transform("t", lambda x: x["safe"]), "").alias("safe"))
    # and of the whole conversation
    conv = conv.withColumn("formatted", F.when(parsed(F.col("plain")).eqNullSafe(F.col("source")), F.col("plain"))
                           .otherwise(F.col("safe")))
    conv = conv.withColumn("turns", parsed(F.col("formatted")))
    return conv.select("conv_id", "formatted", "turns", F.col("turns").eqNullSafe(F.col("source")).alias("exact"))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask: that of one role, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")
