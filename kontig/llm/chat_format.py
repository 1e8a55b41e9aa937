"""Chat formatting by a finite-state machine over roles and a declarative template.

All turns of a conversation are ordered by (turn, role, text). The machine reads their roles; the
template renders each turn as three segments, header, text and end, of which only the texts of loss
roles count for the loss. Inside roles and texts the start of every control string is escaped, so a
formatted conversation can be read back without doubt. Everything is DataFrame functions.

Edge cases: a null text or role counts as empty; turns that repeat are kept, in the stated order; a
null conv_id is a conversation of its own; an empty table gives an empty table; columns beyond the
four are ignored. A conversation that the machine rejects is formatted all the same, with
``valid`` false and the position of the first turn out of order in ``bad_turn``.
A conversation is one output row, so a row is as large as its conversation's text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``marker`` begins every control string and is what gets escaped inside texts."""

    marker: str = "<|"
    turn_start: str = "<|im_start|>"
    role_end: str = "\n"
    turn_end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    #: (state, role) to the next state; what is missing leads to rejection.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )


CHATML = Template()
_REJECT = "reject"


def escape(text: Column, t: Template = CHATML) -> Column:
    """Reversible: ``&`` and the first character of the marker become entities."""
    hidden = f"&#{ord(t.marker[0])};{t.marker[1:]}"
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit(t.marker), F.lit(hidden))


def unescape(text: Column, t: Template = CHATML) -> Column:
    hidden = f"&#{ord(t.marker[0])};{t.marker[1:]}"
    return F.replace(F.replace(text, F.lit(hidden), F.lit(t.marker)), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column, t: Template) -> Column:
    return F.replace(escape(role, t), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(role: Column, t: Template) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")), t)


def _machine(turns: Column, t: Template) -> Column:
    """struct(state, bad): the state after all turns and the first rejected position or null."""

    def step(acc: Column, turn: Column) -> Column:
        after = reduce(lambda rest, m: F.when((acc["state"] == m[0][0]) & (turn["role"] == m[0][1]), F.lit(m[1])).otherwise(rest), t.moves.items(), F.lit(_REJECT))
        bad = F.when(acc["bad"].isNull() & (after == _REJECT), acc["n"]).otherwise(acc["bad"])
        return F.struct(after.alias("state"), bad.alias("bad"), (acc["n"] + 1).alias("n"))

    begin = F.struct(F.lit(t.start).alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("n"))
    return F.aggregate(turns, begin, step)


def format_chats(df: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, turn, role, text) to one row per conversation.

    Columns: conv_id, valid, bad_turn, segments array<struct<text, loss>>, formatted string.
    """
    t = template
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = df.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def segments(x: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(F.concat(F.lit(t.turn_start), _escape_role(x["role"], t), F.lit(t.role_end)), F.lit(False)),
            piece(escape(x["text"], t), x["role"].isin(*t.loss_roles)),
            piece(F.lit(t.turn_end), F.lit(False)),
        )

    run = grouped.select("conv_id", _machine(F.col("turns"), t).alias("m"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return run.select(
        "conv_id",
        F.col("m.state").isin(*t.accept).alias("valid"),
        F.col("m.bad").alias("bad_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """The turns of a formatted conversation, array<struct<role, text>>."""
    t = template
    parts = F.split(formatted, r"\Q" + t.turn_end + r"\E")
    turns = F.slice(parts, 1, F.size(parts) - 1)

    def parse(part: Column) -> Column:
        body = F.substr(part, F.lit(len(t.turn_start) + 1))
        cut = F.instr(body, t.role_end)
        role = F.substr(body, F.lit(1), cut - 1)
        text = F.substr(body, cut + len(t.role_end))
        return F.struct(_unescape_role(role, t).alias("role"), unescape(text, t).alias("text"))

    return F.transform(turns, parse)


def loss_text(segments: Column, template: Template = CHATML) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
