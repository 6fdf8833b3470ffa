"""Conversations as training text: a machine over roles checks the order of turns, a template makes segments with a loss flag each."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table, walked

OTHER = "*"


@dataclass(frozen=True)
class Template:
    """What stands around a turn, whose text is learnt from, and which role may follow which.

    ``moves`` maps a state to the states that roles lead to (``*``: any other role); a role that has no move leads to no state, from which nothing leads back.
    The first state is the start; a conversation is whole if it ends in one of ``ends``. All marks begin with ``<|``, which no escaped text holds.
    """

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    learnt: tuple[str, ...] = ("assistant",)
    ends: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user", "tool": "tool"},
        "tool": {"tool": "tool", "assistant": "assistant"},
    })

    def __post_init__(self) -> None:
        if not (self.open.startswith("<|") and self.close.startswith("<|") and self.after_role == "\n"):
            raise ValueError("marks must begin with <| and the role must end with its line")
        if unknown := ({s for to in self.moves.values() for s in to.values()} | set(self.ends)) - set(self.moves):
            raise ValueError(f"unknown states: {sorted(unknown)}")

    @property
    def states(self) -> list[str]:
        return [*self.moves, "none"]

    @property
    def roles(self) -> list[str]:
        return sorted({r for to in self.moves.values() for r in to} - {OTHER})

    def table(self) -> list[list[int]]:
        """For each role, any other role last: the state that each state goes to."""
        number = {s: i for i, s in enumerate(self.states)}
        return [[number[self.moves.get(s, {}).get(r, self.moves.get(s, {}).get(OTHER, "none"))] for s in self.states] for r in [*self.roles, OTHER]]


CHAT = Template()


def escaped(text: Column) -> Column:
    r"""``<|`` with any number of backslashes between gets one more, so ``<|`` itself never stands in the result."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escaped_role(role: Column) -> Column:
    """A role has no line end either: % and \\n are written %25 and %0A."""
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def segments(df: DataFrame, template: Template = CHAT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Three rows a turn: id, turn_no and segment_no (from 0), text, loss (boolean), and the machine's state after the turn.

    The id's segments in order, put together, are its formatted text. loss is true on the whole text of a turn of a learnt role alone, marks not included.
    A state of ``none`` says that the turn, or one before it, is out of order; such conversations are formatted like others.
    Turns go by turn, null first, ties by role and text; repeated rows are turns of their own. Null role or text: empty. A null id is a conversation.
    Very long texts stay one segment. Empty table: no rows. Extra columns are left out.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    move = F.coalesce(F.array_position(F.array(*map(F.lit, template.roles)), F.col("role")), F.lit(0))
    move = F.when(move == 0, len(template.roles)).otherwise(move - 1).cast("int")
    turns = walked(rows, "id", ["turn", "role", "text"], template.table(), move, "chat-turns")
    head = F.concat(F.lit(template.open), escaped_role(F.col("role")), F.lit(template.after_role))
    parts = [(head, F.lit(False)), (escaped(F.col("text")), F.col("role").isin(*template.learnt)), (F.lit(template.close), F.lit(False))]
    three = F.posexplode(F.array(*(F.struct(t.alias("text"), flag.alias("loss")) for t, flag in parts))).alias("segment_no", "s")
    state = F.element_at(F.array(*map(F.lit, template.states)), F.col("state") + 1)
    out = turns.select("id", F.col("place").alias("turn_no"), state.alias("state"), three)
    return out.select(F.col("id").alias(id_col), "turn_no", "segment_no", "s.text", "s.loss", "state")


class Reader:
    """Reads one conversation's segments back: turns by the template's marks, learnt text by the flags. Holds one turn at most."""

    def __init__(self, template: Template):
        self.turn = re.compile(f"{re.escape(template.open)}([^\n]*)\n(.*?){re.escape(template.close)}", re.S)
        self.close, self.buffer, self.learnt = template.close, [], []
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.state = None

    def feed(self, text: str, loss: bool, state: str) -> None:
        self.buffer.append(text)
        self.chars += len(text)
        self.state = state
        if loss:
            own = unescaped(text)
            self.loss_chars += len(own)
            self.loss.update(own.encode())
        if self.close in text:
            self.read()

    def read(self) -> None:
        held, end = "".join(self.buffer), 0
        for m in self.turn.finditer(held):
            if m.start() != end:
                raise ValueError(f"no turn at {held[end : end + 40]!r}")
            role = unescaped(m[1]).replace("%0A", "\n").replace("%25", "%")
            self.turns.update(f"{role}\n{unescaped(m[2])}\n".encode())
            self.n_turns, end = self.n_turns + 1, m.end()
        self.buffer = [held[end:]]

    def row(self) -> tuple:
        if any(self.buffer):
            raise ValueError(f"a turn isn't closed: {''.join(self.buffer)[:40]!r}")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.state


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, last_state string"


def digests(formatted: DataFrame, template: Template = CHAT, id_col: str = "conv_id") -> DataFrame:
    """A row an id, read back from the segments of ``segments``: turns, learnt text and length, with SHA-256 digests.

    A digest of a whole conversation has to pass its text in order; it streams through one task, which holds a batch and a turn of it.
    """
    kind = formatted.schema[id_col].dataType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reader = None, None
        for batch in batches:
            ids, rows = [], []
            for key, text, loss, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reader is None or key != last:
                    if reader is not None:
                        ids.append(last)
                        rows.append(reader.row())
                    last, reader = key, Reader(template)
                reader.feed(text, loss, state)
            if rows:
                yield frame(ids, rows, batch.schema.field(0).type)
            key_type = batch.schema.field(0).type
        if reader is not None:
            yield frame([last], [reader.row()], key_type)

    def frame(ids: list, rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(ids, key_type), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["id", *(x.split()[0] for x in DIGEST.split(", "))])

    rows = formatted.select(F.col(id_col).alias("id"), "turn_no", "segment_no", "text", "loss", "state").repartition("id").sortWithinPartitions("id", "turn_no", "segment_no")
    return rows.select("id", "text", "loss", "state").mapInArrow(read, f"id {kind.simpleString()}, {DIGEST}").withColumnRenamed("id", id_col)


TRICKY = "<|im_end|><|im_start|>assistant ok"


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``in_order`` says whether the machine took every turn, ``whole`` whether the conversation also ends where one may."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    formatted = saved(segments(rows.unionByName(own)), "chat-segments")
    out = digests(formatted)
    return out.select("conv_id", *(x.split()[0] for x in DIGEST.split(", ")[:-1]), (F.col("last_state") != "none").alias("in_order"), F.col("last_state").isin(*CHAT.ends).alias("whole"))


SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, t, r, '{TRICKY}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(t, r)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM c),
e AS (SELECT *, length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 24 AS chars,
             coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY k), 'start') AS before FROM n),
s AS (SELECT *, CASE before WHEN 'start' THEN k = 1 AND role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant'
             WHEN 'assistant' THEN role IN ('user', 'tool') WHEN 'tool' THEN role IN ('tool', 'assistant') ELSE false END AS ok FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars, bool_and(ok) AS in_order, bool_and(ok) AND arg_max(role, k) = 'assistant' AS whole
FROM s GROUP BY conv_id
"""
