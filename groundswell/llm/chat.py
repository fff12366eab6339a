"""Chat formatting from a declarative template, in SQL expressions only.

A conversation's rows are put in order of turn (role and text break ties) and
become segments: control text around each turn and the turn's own text, each with
a loss flag.  The segments joined are the formatted conversation.  Control
strings inside roles and texts are escaped, so the formatted text can be read back
without loss.  A finite-state machine over the roles, given by the template,
validates the order; `bad_turn` is the first position it refuses, or the number of
turns if the conversation ends in a state that is not final.

Rows are dealt by conversation, because the result is one text per conversation:
a task needs as much memory as its longest conversation's text.

Null texts and roles count as empty, a null conversation id is a conversation of
its own, repeated rows are turns of their own, an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundswell.llm.native import let


@dataclass(frozen=True)
class Template:
    """Marks around a turn, the roles under loss and the machine over roles.

    `mark` begins every control string and never occurs in escaped text; `escape`
    goes before the last character of a mark inside a text.
    """

    mark: str = "<|"
    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>"
    after_turn: str = "\n"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "instructed",
            ("start", "user"): "asked",
            ("instructed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )


CHATML = Template()
REFUSED = "refused"


def escaped(text: Column, t: Template) -> Column:
    """Escapes double; a mark gets one before its last character; a newline becomes escape and `n`, for roles' sake."""
    text = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    return F.replace(text, F.lit(t.mark), F.lit(t.mark[:-1] + t.escape + t.mark[-1]))


def escaped_role(role: Column, t: Template) -> Column:
    return F.replace(escaped(role, t), F.lit("\n"), F.lit(t.escape + "n"))


def unescaped(text: Column, t: Template) -> Column:
    """Undo `escaped` and `escaped_role`: doubled escapes split the text, single ones are resolved between them."""
    quoted = "".join("\\" + c for c in t.escape * 2)
    single = lambda p: F.replace(F.replace(p, F.lit(t.escape + t.mark[-1]), F.lit(t.mark[-1])), F.lit(t.escape + "n"), F.lit("\n"))
    plain = F.array_join(F.transform(F.split(text, quoted, -1), single), t.escape)
    return F.when(F.instr(text, t.escape) > 0, plain).otherwise(text)


def _segments(turns: Column, t: Template) -> Column:
    def of_turn(x: Column) -> Column:
        loss = x["role"].isin(*t.loss_roles)
        return F.array(
            F.struct(F.concat(F.lit(t.open), escaped_role(x["role"], t), F.lit(t.after_role)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(x["text"], t).alias("text"), loss.alias("loss")),
            F.struct(F.lit(t.close + t.after_turn).alias("text"), F.lit(False).alias("loss")),
        )

    return F.flatten(F.transform(turns, of_turn))


def _bad_turn(turns: Column, t: Template) -> Column:
    """Null if the machine accepts."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}\n{role}", to)])

    def step(s: Column, x: Column) -> Column:
        to = F.coalesce(F.try_element_at(moves, F.concat(s["state"], F.lit("\n"), x["role"])), F.lit(REFUSED))
        return F.struct(to.alias("state"), (s["at"] + (to != REFUSED).cast("long")).alias("at"))

    end = F.aggregate(turns, F.struct(F.lit(t.start).alias("state"), F.lit(0).cast("long").alias("at")), step)
    return let(end, lambda s: F.when(~s["state"].isin(*t.final), s["at"]))


def format_conversations(
    rows: DataFrame, template: Template = CHATML, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """`(conv_id, segments array<struct<text, loss>>, formatted, bad_turn)`, one row per conversation."""
    slim = rows.select(
        F.col(id).alias(id),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_t"),
    )
    turns = slim.groupBy(id).agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    done = turns.select(id, _segments(F.col("_turns"), template).alias("segments"), _bad_turn(F.col("_turns"), template).alias("bad_turn"))
    return done.select(id, "segments", F.array_join("segments.text", "").alias("formatted"), "bad_turn")


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """The turns `array<struct<role, text>>` of a formatted conversation."""
    t = template
    quote = lambda s: "".join("\\" + c if not c.isalnum() and c != "\n" else c for c in s)

    def turn(piece: Column) -> Column:
        return let(
            F.instr(piece, t.after_role),
            lambda at: F.struct(
                unescaped(F.substring(piece, F.lit(1), at - 1), t).alias("role"),
                unescaped(F.substring(piece, at + len(t.after_role), F.instr(piece, t.close) - at - len(t.after_role)), t).alias("text"),
            ),
        )

    return let(F.split(formatted, quote(t.open), -1), lambda p: F.transform(F.slice(p, F.lit(2), F.size(p) - 1), turn))


def loss_text(segments: Column, template: Template = CHATML) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
