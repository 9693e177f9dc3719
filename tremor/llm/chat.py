"""Chat formatting: conversations to text segments with loss flags.

A declarative template names the roles, the turn order as a finite-state machine, and
the segments of a turn. ``format_chats`` runs it over whole conversations with array
functions only; ``read_back`` parses the formatted text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col


@dataclass(frozen=True)
class Template:
    """``turn``: the segments of a turn; ``{role}`` and ``{text}`` stand for the turn's
    own. ``loss_roles``: roles whose text carries loss. ``moves``: the state machine,
    (state, role) to state; states not reachable by a role are errors. ``final``: the
    states a valid conversation may end in."""

    turn: tuple[str, ...] = ("<|im_start|>", "{role}", "\n", "{text}", "<|im_end|>\n")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "briefed"), ("start", "user", "asked"), ("briefed", "user", "asked"),
        ("asked", "assistant", "answered"), ("answered", "user", "asked"))
    final: tuple[str, ...] = ("answered",)


CHAT = Template()
OPEN, CLOSE = CHAT.turn[0], CHAT.turn[4]


def escape(text: Column) -> Column:
    """Break up every control string: ``<`` and ``|`` with n backslashes between them get
    one more. No ``<|`` is left, and ``unescape`` takes the backslash out again."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles are one line: percent signs, line feeds and ``<`` are percent-encoded."""
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", template: Template = CHAT) -> DataFrame:
    """One row per conversation: the id column, ``segments`` (array of text and loss, in
    order), ``valid`` (the turn order is accepted) and ``first_error`` (index of the
    first turn that the state machine refuses; null if none).

    All conversations are formatted, also those with an invalid order. A conversation
    is one text, so its turns are gathered in one row.

    Defined cases: a null text or role is the empty string; rows without an id are one
    conversation with a null id; turns with equal numbers are ordered by role and text,
    and repeated rows are turns of their own; an empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    one = F.struct(col(turn_col).alias("turn"), F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"),
                   F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    chats = turns.select(col(id_col).alias("__id"), one.alias("one")).groupBy("__id").agg(
        F.sort_array(F.collect_list("one")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for a, role, b in template.moves for x in (f"{a} {role}", b)])
    state = F.struct(F.lit(template.start).alias("at"), F.lit(0).alias("k"), F.lit(None).cast("int").alias("error"))

    def move(s: Column, t: Column) -> Column:
        to = F.when(s["error"].isNull(), F.element_at(moves, F.concat(s["at"], F.lit(" "), t["role"])))
        return F.struct(F.coalesce(to, F.lit("error")).alias("at"), (s["k"] + 1).alias("k"),
                        F.when(s["error"].isNotNull(), s["error"]).when(to.isNull(), s["k"]).alias("error"))

    def parts(t: Column) -> Column:
        loss = t["role"].isin(*template.loss_roles)
        own = {"{role}": (escape_role(t["role"]), F.lit(False)), "{text}": (escape(t["text"]), loss)}
        pair = lambda p: own.get(p, (F.lit(p), F.lit(False)))
        return F.array(*[F.struct(pair(p)[0].alias("text"), pair(p)[1].alias("loss")) for p in template.turn])

    end = F.aggregate("turns", state, move)
    return chats.select(
        F.col("__id").alias(id_col), F.flatten(F.transform("turns", parts)).alias("segments"), end.alias("__end")).select(
        col(id_col), "segments", (F.col("__end.error").isNull() & F.col("__end.at").isin(*template.final)).alias("valid"),
        F.col("__end.error").alias("first_error"))


def formatted(segments: Column) -> Column:
    """The whole text of a formatted conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_back(text: Column) -> Column:
    """Turns (array of role and text) parsed from a formatted text of ``CHAT``."""
    pieces = F.split(text, r"<\|im_start\|>")

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(CLOSE))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)
