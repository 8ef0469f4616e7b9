"""Chat formatting by grammar round trip.

Template: a turn is an opening mark, the text, and a closing mark.

    user       [INST]text[/INST]
    assistant  <s>text</s>
    system     <<SYS>>text<</SYS>>
    others     <<SYS>>role<</SYS>> in front of a user turn, joined by a pipe: <<SYS>>role<</SYS>>|[INST]text[/INST]

The rendered conversation is reparsed with the grammar, a regular expression that allows one
reading only, and the recovered turns are compared with the source. A conversation that does not
come back as it was is rendered again with its texts escaped, and marked by a leading ``[ESC]``;
the result of that is compared too, and anything still different is an error. Escaping replaces
the first character of every control string in a text by a code, and the escape character itself
by another, so it is reversible: ``\\`` is ``\\0``, ``<`` is ``\\1`` and ``[`` is ``\\2``.

All of it is column expressions; a conversation is one row of (turn, role, text) structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPED = "[ESC]"
#: Where a control string, or the separator of other roles, begins.
_CONTROL = r"<(?=/?s>|<SYS>>|</SYS>>)"
_BRACKET = r"\[(?=/?INST\]|ESC\])"
_TURN = r"(?s)<<SYS>>(?:(?!<</SYS>>).)*+<</SYS>>\|\[INST\].*?\[/INST\]|\[INST\].*?\[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    out = F.regexp_replace(out, _CONTROL, r"\\1")
    return F.regexp_replace(out, _BRACKET, r"\\2")


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\1"), F.lit("<"))
    out = F.replace(out, F.lit("\\2"), F.lit("["))
    return F.replace(out, F.lit("\\0"), F.lit("\\"))


def _render_turn(role: Column, text: Column) -> Column:
    return (
        F.when(role == "user", F.concat(F.lit("[INST]"), text, F.lit("[/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s>"), text, F.lit("</s>")))
        .when(role == "system", F.concat(F.lit("<<SYS>>"), text, F.lit("<</SYS>>")))
        .otherwise(F.concat(F.lit("<<SYS>>"), role, F.lit("<</SYS>>|[INST]"), text, F.lit("[/INST]")))
    )


def render(turns: Column, escaped: bool) -> Column:
    """The formatted conversation of an array of (role, text)."""
    code = escape if escaped else (lambda c: c)
    plain = ("user", "assistant", "system")
    parts = F.transform(turns, lambda t: _render_turn(F.when(t["role"].isin(*plain), t["role"]).otherwise(code(t["role"])), code(t["text"])))
    return F.concat(F.lit(ESCAPED if escaped else ""), F.array_join(parts, ""))


def _inside(part: Column, left: int, right: int) -> Column:
    return F.substring(part, F.lit(left + 1), F.char_length(part) - (left + right))


def parse(formatted: Column) -> Column:
    """Array of (role, text) read from a formatted conversation; null if the grammar does not cover all of it."""
    coded = F.startswith(formatted, F.lit(ESCAPED))
    body = F.when(coded, F.substring(formatted, F.lit(len(ESCAPED) + 1), F.char_length(formatted))).otherwise(formatted)
    found = F.regexp_extract_all(body, F.lit(_TURN), F.lit(0))

    def turn(part: Column) -> Column:
        mark = F.instr(part, "<</SYS>>|[INST]")
        other = F.startswith(part, F.lit("<<SYS>>")) & F.endswith(part, F.lit("[/INST]"))
        role = (
            F.when(F.startswith(part, F.lit("[INST]")), F.lit("user"))
            .when(F.startswith(part, F.lit("<s>")), F.lit("assistant"))
            .when(other, F.substring(part, F.lit(8), mark - 8))
            .otherwise(F.lit("system"))
        )
        text = (
            F.when(F.startswith(part, F.lit("[INST]")), _inside(part, 6, 7))
            .when(F.startswith(part, F.lit("<s>")), _inside(part, 3, 4))
            .when(other, F.substring(part, mark + 15, F.char_length(part) - mark - 14 - 7))
            .otherwise(_inside(part, 7, 8))
        )
        return F.struct(F.when(coded, unescape(role)).otherwise(role).alias("role"), F.when(coded, unescape(text)).otherwise(text).alias("text"))

    return F.when(F.array_join(found, "") == body, F.transform(found, turn))


def conversations_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the (role, text) structs of each conversation by turn.

    Null roles and texts are empty. Rows that share a turn are ordered by role and text, a null
    turn comes first, repeated rows stay; rows with a null conv_id form a conversation.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return listed.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted): the text of each conversation, proved to read back as its source."""
    turns = conversations_of(rows)
    plain = turns.withColumn("plain", render(F.col("turns"), False))
    same = plain.withColumn("same", F.coalesce(parse(F.col("plain")) == F.col("turns"), F.lit(False)) & ~F.startswith("plain", F.lit(ESCAPED)))
    chosen = same.withColumn("formatted", F.when(F.col("same"), F.col("plain")).otherwise(render(F.col("turns"), True)))
    proved = F.col("same") | F.coalesce(parse(F.col("formatted")) == F.col("turns"), F.lit(False))
    checked = F.when(proved, F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return chosen.select("conv_id", checked.alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss): turns read from the text, and what of the text lies under the loss mask, unescaped, in order."""
    read = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), loss_spans(F.col("formatted")).alias("mask"))
    coded = F.startswith("formatted", F.lit(ESCAPED))
    under = F.transform("mask", lambda m: F.substring(F.col("formatted"), m["start"] + 1, m["end"] - m["start"]))
    return read.withColumn("loss", F.array_join(F.transform(under, lambda t: F.when(coded, unescape(t)).otherwise(t)), "")).drop("mask")


def loss_spans(formatted: Column) -> Column:
    """The loss mask: (start, end) code points of the assistant texts in a formatted conversation, as written (escaped).

    Null for null; no spans where no assistant speaks; an empty text has an empty span; equal turns have one each.
    """
    coded = F.startswith(formatted, F.lit(ESCAPED))
    skip = F.when(coded, F.lit(len(ESCAPED))).otherwise(F.lit(0))
    parts = F.regexp_extract_all(F.when(coded, F.substring(formatted, F.lit(len(ESCAPED) + 1), F.char_length(formatted))).otherwise(formatted), F.lit(_TURN), F.lit(0))
    start = F.struct(skip.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, part: Column) -> Column:
        span = F.struct((state["at"] + 3).cast("int").alias("start"), (state["at"] + F.char_length(part) - 4).cast("int").alias("end"))
        spans = F.when(F.startswith(part, F.lit("<s>")), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + F.char_length(part)).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(parts, start, add)["spans"]
