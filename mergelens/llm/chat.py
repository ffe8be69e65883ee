"""Chat formatting with built-in functions: a state machine over roles and a declarative template.

A conversation becomes a list of text segments with a loss flag each; their
concatenation is the formatted text. Markers are the only places where ``[`` and
``<`` occur: in texts and role names these two, ``]`` and the backslash are
replaced by a backslash and a letter, which is reversible and leaves no control
string, so the formatted text alone gives back every turn.

Rows of one conversation are ordered by turn, role and text (nulls first); equal
rows are turns of their own. Null texts and roles read as empty. Rows without a
conversation id form one conversation. A turn whose role has no marker of its own,
or which the machine does not expect, makes the conversation invalid (``valid`` is
false); it is formatted all the same. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Marker:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Markers by role, and which roles may follow a state; a state is the role of the last turn."""

    roles: dict[str, Marker] = field(
        default_factory=lambda: {
            "system": Marker("<<SYS>>", "<</SYS>>"),
            "user": Marker("[INST]", "[/INST]"),
            "assistant": Marker("[OUT]", "</s>", loss=True),
        }
    )
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    other_open: str = "[TURN "
    other_mid: str = "]"
    other_close: str = "[/TURN]"


_ESCAPES = (("\\", "\\e"), ("[", "\\b"), ("]", "\\d"), ("<", "\\l"))


def escape(text: Column) -> Column:
    for plain, code in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _text_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def format_chats(
    turns: DataFrame, template: Template | None = None, conv_id: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``valid``, ``state`` (last role), ``segments`` of text and loss."""
    template = template or Template()
    opens = _text_map({r: m.open for r, m in template.roles.items()})
    closes = _text_map({r: m.close for r, m in template.roles.items()})
    moves = _text_map({f"{state}>{r}": r for state, nexts in template.follows.items() for r in nexts})
    losing = [r for r, m in template.roles.items() if m.loss]

    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    chats = turns.select(F.col(conv_id).alias("conv_id"), one.alias("t"))
    chats = chats.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    error = F.lit("error")
    state = F.aggregate(
        "turns", F.lit("start"),
        lambda at, t: F.coalesce(F.try_element_at(moves, F.concat(at, F.lit(">"), t["role"])), error),
    )

    def segments(t: Column) -> Column:
        other = F.concat(F.lit(template.other_open), escape(t["role"]), F.lit(template.other_mid))
        open_ = F.coalesce(F.try_element_at(opens, t["role"]), other)
        close = F.coalesce(F.try_element_at(closes, t["role"]), F.lit(template.other_close))
        no = F.lit(False)
        parts = [(open_, no), (escape(t["text"]), t["role"].isin(losing)), (close, no)]
        return F.array(*[F.struct(s.alias("text"), loss.alias("loss")) for s, loss in parts])

    return chats.select(
        "conv_id", (state != error).alias("valid"), state.alias("state"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    )


def formatted_text(segments: str = "segments") -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: str = "segments") -> Column:
    """All text under the loss mask, unescaped."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescape(s["text"])), "")


def parse_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) of a formatted text, unescaped."""
    template = template or Template()
    names = _text_map({m.open: r for r, m in template.roles.items()})

    def literal(text: str) -> str:
        return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in text)

    opens = [literal(m.open) for m in template.roles.values()]
    opens.append(literal(template.other_open) + r"[^\[\]<]*" + literal(template.other_mid))
    pattern = F.lit("(" + "|".join(opens) + r")([^\[<]*)")
    marks = F.regexp_extract_all(formatted, pattern, F.lit(1))
    texts = F.regexp_extract_all(formatted, pattern, F.lit(2))
    skip = len(template.other_open)

    def turn(mark: Column, text: Column) -> Column:
        own = mark.substr(F.lit(skip + 1), F.length(mark) - skip - len(template.other_mid))
        role = F.coalesce(F.try_element_at(names, mark), unescape(own))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.zip_with(marks, texts, turn)
