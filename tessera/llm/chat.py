"""Chat formatting (operator 10) by event-sourced reconstruction, in DataFrame operations alone.

Events of a conversation are messages, streamed deltas, edits and regenerations. Within a message the last
message, edit or regenerate event starts its text afresh and later deltas are appended, in sequence. Folded
messages are rendered one by one, joined into runs of consecutive turns and only then into conversations, so
what meets in one place is text that stands in one result row anyway.

Template: control string <|turn|>, role, <|text|> (or <|loss|> for roles under the loss mask), text, <|end|>,
newline. In roles and texts every backslash is doubled, then a backslash is put after the first character of
every control string, of this template or of the common <s> and [INST] ones; removing the backslash before
each escaped character restores the text, whatever it holds.

Defined results: null texts and roles are empty; a null conversation id is a conversation of its own; null
sequence numbers come first; equal ones stand in order of role and text, repeated rows once each; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings that are escaped inside texts.
CONTROL = r"([<\[])(/?s>|/?INST\]|/?<SYS>>|\|turn\|>|\|text\|>|\|loss\|>|\|end\|>)"


def escape(x: Column) -> Column:
    return F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """events (conv_id, message, seq, kind, role, text) to messages (conv_id, message, place, role, text): place is the first sequence number.

    The events of one message meet once, in order; its text is that of the last fresh start and what follows.
    """
    later = F.when(F.col("kind").isin("message", "edit", "regenerate"), 0).otherwise(1)
    log = F.sort_array(F.collect_list(F.struct("seq", later.alias("later"), F.coalesce("text", F.lit("")).alias("text"), "role")))
    met = events.groupBy("conv_id", "message").agg(log.alias("log")).withColumn("last", F.array_max(F.transform(F.filter("log", lambda e: e["later"] == 0), lambda e: e["seq"])))
    last = F.col("last")
    kept = F.filter("log", lambda e: last.isNull() | (e["seq"] > last) | ((e["seq"] == last) & (e["later"] == 0)))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return met.select("conv_id", "message", F.array_min(F.transform("log", lambda e: e["seq"])).alias("place"), F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), run: int = 64) -> DataFrame:
    """messages (conv_id, place, role, text) to (conv_id, formatted)."""
    mark = F.when(F.col("role").isin(*loss_roles), F.lit("<|loss|>")).otherwise(F.lit("<|text|>"))
    turn = F.concat(F.lit("<|turn|>"), escape(F.col("role")), mark, escape(F.col("text")), F.lit("<|end|>\n"))
    runs = messages.select("conv_id", "place", "role", "text", turn.alias("turn")).groupBy("conv_id", F.floor(F.col("place") / run).alias("run")).agg(F.sort_array(F.collect_list(F.struct("place", "role", "text", "turn"))).alias("turns"))
    runs = runs.select("conv_id", "run", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("body"))
    return runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", "body"))).alias("runs")).select("conv_id", F.array_join(F.transform("runs", lambda r: r["body"]), "").alias("formatted"))


def parse(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted) with `turns` read back: an array of role, text and loss."""
    pieces = F.slice(F.split("formatted", r"<\|turn\|>"), 2, 1 << 30)

    def one(piece: Column) -> Column:
        at = r"(?s)^(.*?)<\|(text|loss)\|>(.*)<\|end\|>\n$"
        return F.struct(unescape(F.regexp_extract(piece, at, 1)).alias("role"), unescape(F.regexp_extract(piece, at, 3)).alias("text"), (F.regexp_extract(piece, at, 2) == "loss").alias("loss"))

    return formatted.withColumn("turns", F.transform(pieces, one))


def digest(parsed: DataFrame) -> DataFrame:
    """Counts and digests of what was read back."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return parsed.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))
