"""Chat formatting: a declarative template and a finite-state machine over roles.

A template gives every role its opening and closing marks and whether its text is learned from, and the machine
the roles that may follow each state. Turns become segments, ``(role, text, loss)``: marks without loss, and the
text with the loss flag of its role; joined, they are the formatted conversation. Control strings inside a text
get a backslash after their first character, and backslashes are doubled, so a mark stands only where the
template put it and everything can be read back.

A conversation is one output row, so its turns come together in one task; that is the record itself, not a group
of records, and conversations are independent of each other.

Defined cases: null texts count as empty; a null role is the empty role; roles outside the template are written
with their name and never learned from; an order of roles that the machine refuses is formatted all the same,
with ``valid`` false and the place of the first refused turn; turns are ordered by turn (nulls first), ties by
role and text, repeated rows stay; rows with a null conversation id are one conversation; an empty table gives
no rows. All of it is DataFrame functions.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    begin: str = "<s>"
    end: str = "</s>"
    roles: Mapping[str, Turn] = field(default_factory=lambda: {
        "system": Turn("<<SYS>>\n", "\n<</SYS>>"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("[OUT] ", " [/OUT]", loss=True),
    })
    other: Turn = Turn("[ROLE] ", " [/ROLE]")
    other_text: str = " [TEXT] "
    #: state: roles that may come next; each role is the state after it.
    follows: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })

    def controls(self) -> list[str]:
        marks = [self.begin, self.end, self.other_text]
        for t in (*self.roles.values(), self.other):
            marks += [t.open, t.close]
        return sorted({m.strip() for m in marks})


def escaped(text: Column, template: Template) -> Column:
    by_first: dict[str, list[str]] = {}
    for c in template.controls():
        by_first.setdefault(c[0], []).append(re.escape(c[1:]))
    pattern = "|".join(f"({re.escape(first)})(?={'|'.join(rest)})" for first, rest in sorted(by_first.items()))
    kept = "".join(f"${i + 1}" for i in range(len(by_first)))
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), pattern, kept + "\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _segments(turn: Column, template: Template) -> Column:
    """The three segments of a turn."""
    role, text = turn["role"], escaped(turn["text"], template)
    opening = F.concat(F.lit(template.begin + template.other.open), escaped(role, template), F.lit(template.other_text))
    closing, loss = F.lit(template.other.close + template.end), F.lit(False)
    for name, t in template.roles.items():
        opening = F.when(role == name, F.lit(template.begin + t.open)).otherwise(opening)
        closing = F.when(role == name, F.lit(t.close + template.end)).otherwise(closing)
        loss = F.when(role == name, F.lit(t.loss)).otherwise(loss)
    part = lambda text, loss: F.struct(role.alias("role"), text.alias("text"), loss.alias("loss"))
    return F.array(part(opening, F.lit(False)), part(text, loss), part(closing, F.lit(False)))


def _run_machine(turns: Column, template: Template) -> Column:
    """The number of the first refused turn, from 0; null if there is none."""

    def step(acc: Column, turn: Column) -> Column:
        allowed = F.lit(False)
        for state, nexts in template.follows.items():
            allowed = allowed | ((acc["state"] == state) & turn["role"].isin(*nexts))
        return F.struct(turn["role"].alias("state"), (acc["at"] + 1).alias("at"), F.when(acc["bad"].isNotNull() | allowed, acc["bad"]).otherwise(acc["at"]).alias("bad"))

    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))
    return F.aggregate(turns, start, step, lambda acc: acc["bad"])


def format_chats(
    rows: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv_id, n_turns, valid, bad_turn, segments and formatted, one row a conversation."""
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    chats = rows.groupBy(F.col(f"`{conv_col}`").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    made = chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), _run_machine(F.col("turns"), template).alias("bad_turn"),
        F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"),
    )
    return made.select(
        "conv_id", "n_turns", F.col("bad_turn").isNull().alias("valid"), "bad_turn", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted")
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """``array<struct<role, text>>`` of a formatted conversation."""

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(len(template.begin) + 1), F.length(part))
        inner = lambda t: F.substr(body, F.lit(len(t.open) + 1), F.length(body) - len(t.open) - len(t.close))
        rest = inner(template.other)
        cut = F.instr(rest, F.lit(template.other_text))
        role = F.substr(rest, F.lit(1), cut - 1)
        text = F.substr(rest, cut + len(template.other_text), F.length(rest))
        for name, t in template.roles.items():
            role = F.when(F.startswith(body, F.lit(t.open)), F.lit(name)).otherwise(role)
            text = F.when(F.startswith(body, F.lit(t.open)), inner(t)).otherwise(text)
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    parts = F.split(formatted, re.escape(template.end), -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def learned_text(segments: Column) -> Column:
    """All text under the loss flag, in order, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
