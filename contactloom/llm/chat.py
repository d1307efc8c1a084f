"""Chat formatting with a declarative template: a finite-state machine over roles, text segments with
loss flags, and the way back. DataFrame functions only.

Marks never occur in a formatted text by accident: a backslash in a text is doubled, and one is put
behind the first character of every mark. Reading back drops the backslash of each such pair.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks and loss per role, and the order in which roles may follow each other.

    Roles without an entry use ``other``, with the role's name and ``named`` before the text.
    """

    begin: str = "<s>"
    turns: Mapping[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("<<SYS>>", "<</SYS>>"),
            "user": Turn("[INST]", "[/INST]"),
            "assistant": Turn("[OUT]", "</s>", loss=True),
        }
    )
    other: Turn = Turn("[TURN]", "[/TURN]")
    named: str = "[AS]"
    follows: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    ends: tuple[str, ...] = ("assistant",)

    @property
    def marks(self) -> list[str]:
        pairs = [*self.turns.values(), self.other]
        return [self.begin, self.named, *(m for t in pairs for m in (t.open, t.close))]


DEFAULT = Template()


def _any(marks: list[str]) -> str:
    return "|".join(re.escape(m) for m in marks)


def escape(text: Column, template: Template = DEFAULT) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    starts = "|".join(f"(?<={re.escape(m[0])})(?={re.escape(m[1:])})" for m in template.marks)
    return F.regexp_replace(doubled, starts, "\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _order(turns: Column, template: Template) -> Column:
    """Runs the machine; gives the last state and the place of the first turn that may not follow."""
    moves = [F.lit(x) for state, roles in template.follows.items() for r in roles for x in (f"{state}>{r}", r)]
    table = F.create_map(*moves)

    def step(state, turn):
        to = F.try_element_at(table, F.concat(state["state"], F.lit(">"), turn["role"]))
        bad = F.when(state["bad"].isNull() & to.isNull(), turn["place"]).otherwise(state["bad"])
        return F.struct(F.coalesce(to, turn["role"]).alias("state"), bad.alias("bad"))

    return F.aggregate(turns, F.struct(F.lit("").alias("state"), F.lit(None).cast("int").alias("bad")), step)


def format_conversations(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """``conv_id, segments, formatted, valid, first_bad``: one row per conversation.

    Rows are taken by ``turn``, equal turns by role, then text; null turns come first; repeated rows
    are turns of their own. Null roles and texts are empty, rows without ``conv_id`` are one
    conversation. Segments are ``text, loss``; joined they are ``formatted``. Turns in a wrong order
    are formatted all the same: ``valid`` says whether the order is right to its end, ``first_bad``
    (from 0) which turn broke it. A whole conversation is one output row.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    turns = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), t["text"].alias("text"), i.alias("place")))

    def part(role: Column, which: str) -> Column:
        out = F.lit(getattr(template.other, which))
        for name, marks in template.turns.items():
            out = F.when(role == name, F.lit(getattr(marks, which))).otherwise(out)
        return out

    def segment(text, loss) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def written(t: Column) -> Column:
        named = F.when(t["role"].isin(*template.turns), "").otherwise(F.concat(escape(t["role"], template), F.lit(template.named)))
        no = F.lit(False)
        return F.array(
            segment(F.concat(part(t["role"], "open"), named), no),
            segment(escape(t["text"], template), part(t["role"], "loss")),
            segment(part(t["role"], "close"), no),
        )

    begin = F.array(segment(F.lit(template.begin), F.lit(False)))
    done = (
        grouped.withColumn("turns", turns)
        .withColumn("order", _order(F.col("turns"), template))
        .withColumn("segments", F.concat(begin, F.flatten(F.transform("turns", written))))
    )
    ended = F.col("order.state").isin(*template.ends) & F.col("order.bad").isNull()
    return done.select(
        "conv_id", "segments", F.array_join("segments.text", "").alias("formatted"), ended.alias("valid"),
        F.col("order.bad").alias("first_bad"),
    )


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """Array of ``role, text`` that a formatted conversation holds."""
    pairs = [*template.turns.values(), template.other]
    pattern = F.lit(f"(?s)({_any([t.open for t in pairs])})(.*?)({_any([t.close for t in pairs])})")
    opens, bodies = F.regexp_extract_all(formatted, pattern, F.lit(1)), F.regexp_extract_all(formatted, pattern, F.lit(2))

    def turn(open_: Column, body: Column) -> Column:
        at = F.instr(body, template.named)
        role, text = body.substr(F.lit(1), at - 1), body.substr(at + len(template.named), F.length(body))
        for name, marks in template.turns.items():
            role = F.when(open_ == marks.open, name).otherwise(role)
        text = F.when(open_ == template.other.open, text).otherwise(body)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.zip_with(opens, bodies, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
