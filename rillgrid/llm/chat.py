"""Chat formatting with a grammar that is parsed back, in DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"

#: Control strings of chat templates; inside a text each is escaped.
RESERVED = (START, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_ROLE = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"))


def escape(text: Column, reserved: Sequence[str] = RESERVED) -> Column:
    """Each control string gets a backslash after its first character.

    One that already has backslashes there gets one more, so nothing else can read
    like an escaped one and ``unescape`` takes exactly one away.
    """
    for first, rests in _by_first(reserved):
        text = F.regexp_replace(text, rf"{first}(?=\\*(?:{rests}))", rf"{first}\\")
    return text


def unescape(text: Column, reserved: Sequence[str] = RESERVED) -> Column:
    for first, rests in _by_first(reserved):
        text = F.regexp_replace(text, rf"{first}\\(?=\\*(?:{rests}))", first)
    return text


def _by_first(reserved: Sequence[str]) -> list[tuple[str, str]]:
    """Patterns of the first characters, each with that of what may follow it."""
    out: dict[str, list[str]] = {}
    for x in reserved:
        out.setdefault(x[0], []).append(re.escape(x[1:]))
    return [(re.escape(k), "|".join(v)) for k, v in out.items()]


def _role(role: Column, back: bool = False) -> Column:
    for plain, coded in reversed(_ROLE) if back else _ROLE:
        role = F.replace(role, F.lit(coded if back else plain), F.lit(plain if back else coded))
    return role


def parse(formatted: Column, reserved: Sequence[str] = RESERVED) -> Column:
    """The turns of a formatted conversation, as an array of ``(role, text)``.

    The grammar is regular: ``START role LF body END LF``, where neither a role nor a
    body holds ``START`` or ``END``, so one split finds every turn.
    """
    turns = F.slice(F.split(formatted, re.escape(START)), 2, 1 << 30)

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        body = F.substring(x, F.char_length(role) + 2, F.char_length(x) - F.char_length(role) - 2 - len(END))
        return F.struct(_role(role, back=True).alias("role"), unescape(body, reserved).alias("text"))

    return F.transform(turns, turn)


def joined(turns: Column) -> Column:
    """Role, line end, text and line end of each turn, one after the other."""
    return F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")


def format_chats(
    conversations: DataFrame,
    *,
    learn: str = "assistant",
    reserved: Sequence[str] = RESERVED,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, loss_spans, identical``.

    Turns are ordered by ``turn``, then role and text. Control strings in texts are
    escaped; a role's ``%``, ``<``, ``[`` and line ends are percent-coded. ``loss_spans`` are the
    places ``(start, length)``, in code points from 0, of the bodies of turns by
    ``learn``. ``formatted`` is parsed again and the turns it gives are compared with
    the source: ``identical``. Offsets are running sums, so nothing is searched for.

    A null text or role is an empty one; null ids make one conversation; a null turn
    comes first; repeated rows are turns of their own. An empty table gives no rows;
    further columns are not read. A conversation is one string, and so in one task.
    """
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"))
    rows = rows.withColumns({"head": head, "body": escape(F.col("text"), reserved)})
    rows = rows.withColumn("rendered", F.concat("head", "body", F.lit(f"{END}\n")))
    upto = F.sum(F.char_length("rendered").cast("long")).over(
        Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = rows.withColumn("upto", upto)
    length = F.char_length("body").cast("long")
    span = F.struct((F.col("upto") - len(END) - 1 - length).alias("start"), length.alias("length"))
    turns = F.sort_array(F.collect_list(F.struct("upto", "rendered", "role", "text", span.alias("span"))))
    whole = rows.groupBy("conv_id").agg(turns.alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda x: x["rendered"]), "")
    spans = F.transform(F.filter("turns", lambda x: x["role"] == learn), lambda x: x["span"])
    source = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    made = whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), formatted.alias("formatted"), spans.alias("loss_spans"), source.alias("source"))
    return made.select("conv_id", "n_turns", "formatted", "loss_spans", (parse(F.col("formatted"), reserved) == F.col("source")).alias("identical"))


def masked(formatted: Column, spans: Column, reserved: Sequence[str] = RESERVED) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda x: unescape(F.substring(formatted, (x["start"] + 1).cast("int"), x["length"].cast("int")), reserved)), "")
