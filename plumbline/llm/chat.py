"""Chat formatting by a grammar round trip: what a deterministic parser reads back must equal the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Turns as roles open and close them; any other role is written out, up to ``[AS]``.
OPEN = {"system": "[SYS]", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "[/SYS]", "user": "[/INST]", "assistant": "</s>"}
CONTROL = r"</?s>|\[/?(?:SYS|INST|ROLE)\]|\[AS\]"
TURN = r"(?s)\[SYS\] .*? \[/SYS\]|\[INST\] .*? \[/INST\]|<s> .*? </s>|\[ROLE\] .*? \[AS\] .*? \[/ROLE\]"
SEPARATOR = "\n"


def escape(text: Column) -> Column:
    """A backslash before every control string."""
    return F.regexp_replace(text, f"({CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    """One backslash less before every control string; undoes ``escape``, since control strings neither hold a
    backslash nor overlap."""
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def lead(role: Column) -> Column:
    """What stands before a turn's text."""
    known = F.when(role == "system", F.lit("[SYS] ")).when(role == "user", F.lit("[INST] ")).when(role == "assistant", F.lit("<s> "))
    return known.otherwise(F.concat(F.lit("[ROLE] "), escape(role), F.lit(" [AS] ")))


def tail(role: Column) -> Column:
    """What stands after a turn's text."""
    known = F.when(role == "system", F.lit(" [/SYS]")).when(role == "user", F.lit(" [/INST]")).when(role == "assistant", F.lit(" </s>"))
    return known.otherwise(F.lit(" [/ROLE]"))


def body_of(turn: Column) -> Column:
    """The text of a turn as written."""
    named = F.regexp_extract(turn, r"(?s)\A\[ROLE\] .*? \[AS\] (.*) \[/ROLE\]\z", 1)
    return F.when(turn.startswith("[ROLE] "), named).otherwise(F.regexp_extract(turn, r"(?s)\A\S+ (.*) \S+\z", 1))


def read_turn(turn: Column) -> Column:
    """``role, text`` of one turn of the grammar."""
    role = F.when(turn.startswith("[INST] "), F.lit("user")).when(turn.startswith("<s> "), F.lit("assistant")).when(turn.startswith("[SYS] "), F.lit("system"))
    role = role.otherwise(unescape(F.regexp_extract(turn, r"(?s)\A\[ROLE\] (.*?) \[AS\] ", 1)))
    return F.struct(role.alias("role"), unescape(body_of(turn)).alias("text"))


def turns_of(formatted: Column) -> Column:
    """The turns a formatted conversation is made of, as written."""
    return F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))


def bare(body: Column) -> Column:
    """Whether a text as written holds a control string without a backslash, which the grammar forbids."""
    return body.rlike(rf"(?<!\\)(?:{CONTROL})")


def parse(rows: DataFrame, formatted: str = "formatted", into: str = "turns") -> DataFrame:
    """The rows with the turns ``array<struct<role, text>>`` that a formatted conversation holds.

    A text that the grammar does not derive as a whole has null turns, so has null; the empty text has none.
    """
    written = rows.withColumn("__written", turns_of(F.col(formatted)))
    whole = (F.array_join("__written", SEPARATOR) == F.col(formatted)) & ~F.exists("__written", lambda t: bare(body_of(t)))
    return written.withColumn(into, F.when(whole, F.transform("__written", read_turn))).drop("__written")


def fits(role: Column, text: Column) -> Column:
    """Whether a turn, written as it is, is read back as this one turn."""
    written = F.concat(lead(role), text, tail(role))
    again = turns_of(written)
    return (F.size(again) == 1) & (again[0] == written) & ~bare(text) & (read_turn(written)["text"] == text)


def format_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, formatted, segments``: one row per conversation; ``segments`` are the consecutive parts of
    ``formatted`` with ``loss``, whether the part is an assistant's text.

    Every turn is written as it is and reparsed; where the parser does not read the same turn, its
    control strings are escaped.  The whole conversation is then parsed and held against its
    source; the job fails if they differ, so what comes out is always read back exactly.

    Null roles and texts count as empty; any role is allowed.  Turns are in ascending order (null
    first), turns of one number by role and text; rows that repeat are turns of their own; rows
    without a conversation are one.  An empty table gives no rows.  A conversation is one value of
    one row, like a document: nothing else gathers its turns.
    """
    turns = rows.select(
        rows[conv_col].alias("conv_id"), rows[turn_col].alias("turn"),
        F.coalesce(rows[role_col], F.lit("")).alias("role"), F.coalesce(rows[text_col], F.lit("")).alias("text"),
    )
    # only a text with a bracket of either kind can hold a control string
    plain = ~(F.contains("text", F.lit("[")) | F.contains("text", F.lit("<")))
    body = F.when(plain | fits(F.col("role"), F.col("text")), F.lit(None)).otherwise(escape(F.col("text")))
    grouped = turns.withColumn("escaped", body).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "escaped"))).alias("source")
    )

    def segments(x: Column, at: Column) -> Column:
        before = F.concat(F.when(at > 0, F.lit(SEPARATOR)).otherwise(F.lit("")), lead(x["role"]))
        texts = [before, F.coalesce(x["escaped"], x["text"]), tail(x["role"])]
        losses = [F.lit(False), x["role"] == "assistant", F.lit(False)]
        return F.array(*[F.struct(t.alias("text"), loss.alias("loss")) for t, loss in zip(texts, losses, strict=True)])

    written = grouped.withColumn("segments", F.flatten(F.transform("source", segments)))
    written = written.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    checked = parse(written, into="__turns")
    source = F.transform("source", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    same = F.col("__turns").eqNullSafe(source)
    formatted = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation is not read back as it was")).cast("string"))
    return checked.select("conv_id", formatted.alias("formatted"), "segments")


def loss_text(segments: str = "segments") -> Column:
    """All text under the loss mask, unescaped part by part, nothing between."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescape(s["text"])), "")
