"""Chat formatting: a role automaton checks turn order, a template emits segments with loss flags.

A turn becomes three segments: opening mark with the role, the text, the closing mark. Only text
segments of the template's loss roles carry the loss flag. Texts and roles are escaped so that the
marks cannot occur inside them, and the escape can be undone exactly.

The automaton runs by composing maps: a turn maps every state to the next one, maps of consecutive
turns compose, and a fixed number of neighbours is composed at a time until one map per
conversation is left. So a conversation with any number of turns never meets in one task.

Turns are ordered by (turn, role, text), nulls first; repeated rows are turns of their own. Null
roles and texts count as empty; an empty role is unknown to the automaton, so the conversation is
not valid, but it is formatted like any other. A null conversation id is one conversation. An
empty table gives no segments. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .prefix import running

FAN_IN = 256


@dataclass(frozen=True)
class Template:
    """What is written around a turn, which roles are learned, and which role may follow which."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>"
    after_turn: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state
    moves: dict = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    })

    @property
    def states(self) -> list[str]:
        return sorted({self.start, *self.moves, *(s for m in self.moves.values() for s in m.values())})


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\\``, the mark opener ``<|`` becomes ``<\|``, a line break in a role ``\n``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Undo either escape: between doubled backslashes, a single one only stands before ``|`` or ``n``."""
    plain = lambda p: F.replace(F.replace(p, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, role, text``: positions from 0, found without gathering a conversation."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = cut_lineage(conversations.select("conv_id", "turn", blank("role"), blank("text")))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return running(rows, ["conv_id"], order, F.lit(1), "pos").drop("turn")


def fold(rows: DataFrame, at: str, value: str, combine) -> DataFrame:
    """``conv_id, value``: combine a conversation's values in order of ``at``, FAN_IN at a time."""
    rows = rows.select("conv_id", F.col(at).alias("_at"), F.col(value).alias("_value"))
    top = rows.agg(F.max("_at")).first()[0]
    while top is not None:
        near = F.floor(F.col("_at") / FAN_IN).alias("_next")
        rows = rows.groupBy("conv_id", near).agg(
            combine(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_value"))), lambda x: x["_value"])).alias("_value")
        ).withColumnRenamed("_next", "_at")
        if top < FAN_IN:
            break
        rows, top = cut_lineage(rows), top // FAN_IN
    return rows.select("conv_id", F.col("_value").alias(value))


def validate(turns: DataFrame, template: Template) -> DataFrame:
    """``conv_id, valid``: every move is allowed and the conversation ends in an accepting state."""
    states = template.states
    dead = F.lit(len(states))

    def move(state: str) -> Column:
        out = dead
        for role, target in template.moves.get(state, {}).items():
            out = F.when(F.col("role") == role, F.lit(states.index(target))).otherwise(out)
        return out

    step = turns.withColumn("_map", F.array(*[move(s) for s in states], dead))
    compose = lambda maps: F.transform(
        F.sequence(F.lit(0), dead), lambda s: F.aggregate(maps, s, lambda state, m: F.get(m, state))
    )
    end = F.get(F.col("_map"), F.lit(states.index(template.start)))
    return fold(step, "pos", "_map", compose).select("conv_id", end.isin([states.index(s) for s in template.accept]).alias("valid"))


def segments(turns: DataFrame, template: Template) -> DataFrame:
    """``conv_id, seg, kind, role, text, loss``; texts joined in order of ``seg`` are the formatted chat."""
    learn = F.col("role").isin(list(template.loss_roles))
    part = lambda k, kind, text, loss: F.struct(
        (F.col("pos") * 3 + k).alias("seg"), F.lit(kind).alias("kind"), "role", text.alias("text"), loss.alias("loss")
    )
    head = F.concat(F.lit(template.open), escape_role(F.col("role")), F.lit(template.after_role))
    parts = F.array(
        part(0, "open", head, F.lit(False)),
        part(1, "text", escape(F.col("text")), learn),
        part(2, "close", F.lit(template.close + template.after_turn), F.lit(False)),
    )
    return turns.select("conv_id", F.explode(parts).alias("p")).select("conv_id", "p.*")


def format_chat(conversations: DataFrame, template: Template | None = None) -> tuple[DataFrame, DataFrame]:
    """Segments, and the verdict per conversation (``conv_id, valid``)."""
    template = template or Template()
    turns = ordered_turns(conversations)
    return segments(turns, template), validate(turns, template)


def read_back(segs: DataFrame, template: Template | None = None) -> DataFrame:
    """``conv_id, formatted, turns array<struct<role, text>>, loss_text``, from the segments alone.

    A conversation's whole string is one value here, as its digest needs; that is the one place
    where a conversation must fit in a row (2 GB).
    """
    template = template or Template()
    joined = lambda parts: F.array_join(parts, "")
    quote = lambda s: r"\Q" + s + r"\E"
    turn = F.lit(f"(?s){quote(template.open)}(.*?){quote(template.after_role)}(.*?){quote(template.close + template.after_turn)}")
    pick = lambda k: F.regexp_extract_all("formatted", turn, F.lit(k))
    both = segs.withColumn("formatted", F.col("text")).withColumn("loss_text", F.when(F.col("loss"), unescape(F.col("text"))).otherwise(""))
    whole = fold(both.withColumn("both", F.struct("formatted", "loss_text")), "seg", "both", lambda parts: F.struct(
        joined(F.transform(parts, lambda x: x["formatted"])).alias("formatted"),
        joined(F.transform(parts, lambda x: x["loss_text"])).alias("loss_text"),
    ))
    said = F.zip_with(pick(1), pick(2), lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))
    return whole.select("conv_id", "both.*").withColumn("turns", said)
