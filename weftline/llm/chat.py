"""Chat formatting by grammar round trip, in DataFrame functions only.

Turns are rendered with plain texts and parsed again by a deterministic grammar. Where the turns recovered differ from
the source, control strings in its texts are escaped and the rendering is parsed anew; what comes out reads back as
the same turns.

    conversation: turn*
    turn:         open ' ' body ' ' close
    open, close:  <<SYS>> <</SYS>> | [INST] [/INST] | <s> </s> | [ROLE:hex] [/ROLE]

A control string that a backslash precedes is text. Escaping puts one more backslash before the backslashes, if any,
that stand before a control string; unescaping takes one away.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = r"(?:<<SYS>>|\[INST\]|<s>|\[ROLE:[0-9A-F]*\])"
CONTROL = r"(?:<(?:</?SYS>>|/?s>)|\[(?:/?INST|/ROLE|ROLE:[0-9A-F]*)\])"
#: Cuts before each control string that isn't escaped.
CUTS = rf"(?={CONTROL})(?<!\\)"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for a row, however often and in whatever lambda use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*{CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*{CONTROL})", "$1")


def _marks(role: Column) -> tuple[Column, Column]:
    first = F.when(role == "system", "<<SYS>>").when(role == "user", "[INST]").when(role == "assistant", "<s>").otherwise(F.concat(F.lit("[ROLE:"), F.hex(role), F.lit("]")))
    last = F.when(role == "system", "<</SYS>>").when(role == "user", "[/INST]").when(role == "assistant", "</s>").otherwise("[/ROLE]")
    return first, last


def render(turns: Column, escaped: bool) -> Column:
    """The text of an array of (role, text)."""

    def one(t: Column) -> Column:
        first, last = _marks(t["role"])
        return F.concat(first, F.lit(" "), escape(t["text"]) if escaped else t["text"], F.lit(" "), last)

    return F.array_join(F.transform(turns, one), "")


def pieces(text: Column) -> Column:
    """The text cut before every control string: what opens a turn with its body, and what closes it, by turns."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, CUTS))


def parse(text: Column) -> Column:
    """The turns (role, text) of a rendered text; null if the grammar doesn't fit."""

    def turn(a: Column, z: Column) -> Column:
        def body(mark: Column) -> Column:
            role = F.when(mark == "<<SYS>> ", "system").when(mark == "[INST] ", "user").when(mark == "<s> ", "assistant").when(mark != "", F.unhex(F.regexp_extract(mark, "[0-9A-F]*(?=])", 0)).cast("string"))
            whole = (mark != "") & a.endswith(" ") & (F.length(a) > F.length(mark)) & (_marks(role)[1] == z)
            return F.when(whole, F.struct(role.alias("role"), unescape(F.substring(a, F.length(mark) + 1, F.length(a) - F.length(mark) - 1)).alias("text")))

        return bound(F.regexp_extract(a, rf"^{OPEN} ", 0), body)

    def turns(cuts: Column) -> Column:
        pairs = F.filter(F.transform(cuts, lambda a, i: F.when(i % 2 == 0, F.struct(a.alias("a"), F.get(cuts, i + 1).alias("z")))), lambda p: p.isNotNull())
        empty = F.array().cast("array<struct<role:string,text:string>>")
        return F.when(F.size(cuts) == 0, empty).when(F.size(cuts) % 2 == 0, F.transform(pairs, lambda p: turn(p["a"], p["z"])))

    return bound(pieces(text), turns)


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns, formatted, loss_spans): one row per conversation.

    turns: the source, as an array of (role, text) by turn; rows that tie on it are ordered by role and text. Null roles
    and texts count as empty; rows of a null conversation are one conversation. loss_spans: (start from 1, length) of
    the assistant's texts in formatted, in code points and as escaped there. Other columns are left out. A conversation
    is one text, so its rows meet in one task; nothing else is gathered.
    """
    each = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(each)).alias("all"))
    turns = grouped.select("conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    tried = turns.withColumn("plain", render(F.col("turns"), False))
    same = F.coalesce(parse(F.col("plain")) == F.col("turns"), F.lit(False))
    done = tried.select("conv_id", "turns", F.when(same, F.col("plain")).otherwise(render(F.col("turns"), True)).alias("formatted"))

    def spans(s: Column, p: Column) -> Column:
        own = F.when(p.startswith("<s> "), F.array(F.struct((s["at"] + F.lit(5)).alias("start"), (F.length(p) - F.lit(5)).alias("length")))).otherwise(F.array().cast("array<struct<start:int,length:int>>"))
        return F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["spans"], own).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return done.withColumn("loss_spans", F.aggregate(pieces(F.col("formatted")), none, spans, lambda s: s["spans"]))


def read_back(chats: DataFrame) -> DataFrame:
    """chats with read_turns, parsed from formatted, and loss_text: the texts under the loss mask, unescaped."""
    loss = bound(F.col("formatted"), lambda text: F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(text, s["start"], s["length"]))), ""))
    return chats.withColumns({"read_turns": parse(F.col("formatted")), "loss_text": loss})
