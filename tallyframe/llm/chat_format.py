r"""Chat formatting: a finite-state machine over roles, and text segments with loss flags.

A template declares the heading of each role, the end of a turn, who is learned from and which role may follow
which. Each turn becomes three segments: heading, body, end mark. Only the body of a learned role carries the
loss flag. Bodies are escaped: ``\`` goes before every ``\`` and before every control string, so no body holds
a bare control string and the turns can be read back without loss.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What a formatted conversation looks like.

    ``states``: from each state the roles that may come next, with the state they lead to; a conversation is
    complete when it ends in one of ``final``. Roles without a name in ``names`` are written as they are.
    """

    mark: str = "### "
    after_role: str = ": "
    end: str = " </turn>\n"
    names: dict[str, str] = field(
        default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"}
    )
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    states: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        for text in (self.mark, self.after_role, self.end):
            bordered = any(text.startswith(text[-n:]) for n in range(1, len(text)))
            if not text.strip() or bordered or "\\" in text:
                raise ValueError(f"{text!r} can't be told apart from what stands around it")
        if any(n.startswith("=") or self.after_role[0] in n for n in self.names.values()):
            raise ValueError("a role's name can't be read back")

    def escape(self, text: str) -> str:
        return re.sub(rf"\\|(?={re.escape(self.mark.strip())}|{re.escape(self.end.strip())})", r"\\\g<0>", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def heading(self, role: str) -> str:
        name = self.names.get(role)
        if name is None:
            name = "=" + re.sub(rf"([\\{re.escape(self.after_role[0])}])", r"\\\1", role)
        return self.mark + name + self.after_role

    def read_turns(self, formatted: str) -> list[tuple[str, str]]:
        """Role and text of every turn, from the formatted text alone."""
        name = rf"((?:[^\\{re.escape(self.after_role[0])}]|\\.)*)"
        parts = (re.escape(self.mark), name, re.escape(self.after_role), r"((?:[^\\]|\\.)*?)", re.escape(self.end))
        turn = re.compile("".join(parts), re.DOTALL)
        roles, turns, at = {v: k for k, v in self.names.items()}, [], 0
        while at < len(formatted):
            found = turn.match(formatted, at)
            if not found:
                raise ValueError(f"no turn at {at}")
            said, at = found[1], found.end()
            role = self.unescape(said[1:]) if said.startswith("=") else roles[said]
            turns.append((role, self.unescape(found[2])))
        return turns


SEGMENTS = "{conv} {kind}, seq long, part string, text string, loss boolean, error string"


def format_segments(
    conversations: DataFrame,
    template: Template | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Three rows per turn: ``conv_col``, ``seq``, ``part`` (heading, body, end), ``text``, ``loss``, ``error``.

    Turns are ordered by turn number (null first), then role and text; ``seq`` counts the segments of a
    conversation from 0. Null role and text count as empty; rows with a null conversation are one
    conversation. Repeated rows are turns of their own. ``error`` holds, at the heading of a turn that the
    machine does not accept, what was wrong, and at the last end mark ``incomplete`` if the conversation may not
    end there; after a wrong turn the machine goes on from where that role would lead from any state. An
    empty table gives an empty result; other columns are not read.

    Conversations stream through the tasks turn by turn, so a long one needs no more memory than a short one.
    """
    shape = template or Template()
    leads = {role: state for moves in shape.states.values() for role, state in moves.items()}
    rows = conversations.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    kind = rows.schema["conv"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, seq, pending = object(), shape.start, 0, None
        for batch in batches:
            out = []
            for now, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if pending is not None and now != conv:
                    out.append((*pending, None if state in shape.final else "incomplete"))
                    pending = None
                if now != conv:
                    conv, state, seq = now, shape.start, 0
                if pending is not None:
                    out.append((*pending, None))
                moves = shape.states.get(state, {})
                error = None if role in moves else f"{role or 'no role'} after {state}"
                state = moves.get(role, leads.get(role, state))
                out.append((conv, seq, "heading", shape.heading(role), False, error))
                out.append((conv, seq + 1, "body", shape.escape(text), role in shape.learned, None))
                pending = (conv, seq + 2, "end", shape.end, False)
                seq += 3
            if out:
                yield _batch(out, batch.column(0).type)
        if pending is not None:
            yield _batch([(*pending, None if state in shape.final else "incomplete")], batch.column(0).type)

    schema = SEGMENTS.format(conv="conv", kind=kind)
    in_order = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return in_order.mapInArrow(walk, schema).withColumnRenamed("conv", conv_col)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()]
    names = ["conv", "seq", "part", "text", "loss", "error"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def join_segments(segments: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation: ``conv_col``, ``formatted``, ``loss_spans`` (code points), ``errors``."""
    parts = segments.groupBy(conv_col).agg(
        F.array_sort(F.collect_list(F.struct("seq", "text", "loss", "error"))).alias("parts")
    )
    step = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<from:int,upto:int>>)").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["text"])).alias("at"),
            F.when(
                p["loss"],
                F.concat(
                    acc["spans"],
                    F.array(F.struct(acc["at"].alias("from"), (acc["at"] + F.length(p["text"])).alias("upto"))),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return parts.select(
        conv_col,
        F.array_join("parts.text", "").alias("formatted"),
        step["spans"].alias("loss_spans"),
        F.filter("parts.error", lambda e: e.isNotNull()).alias("errors"),
    )
