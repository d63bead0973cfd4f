"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation, as a sequence of turns:

    user       [INST] text [/INST]
    assistant  (a space) text</s>
    any other  [ROLE name] text [/ROLE]

A backslash makes the character behind it plain text. A turn is rendered, parsed again by the
deterministic parser below and compared with its source; where they differ, conflicting
strings are escaped, and then backslashes too, until they are identical. Every turn ends by
itself, so turns are rendered and checked row by row wherever they lie; only reading a
conversation back needs its turns in order, and that streams through sorted partitions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import workspace, written

USER, USER_END = "[INST] ", " [/INST]"
ASSISTANT, ASSISTANT_END = " ", "</s>"
ROLE, ROLE_END, TURN_END = "[ROLE ", "] ", " [/ROLE]"
# What no text may hold unescaped: every opening and closing string, less the spaces around it.
CONTROL = re.compile(r"</s>|<s>|\[/?INST\]|\[/?ROLE")
NAME_CONTROL = re.compile(r"\]")
_STEP = re.compile(r"\\(.)|" + CONTROL.pattern, re.S)
_NAME_STEP = re.compile(r"\\(.)|" + NAME_CONTROL.pattern, re.S)


def escape(text: str, level: int, control: re.Pattern = CONTROL) -> str:
    """0: as it is; 1: control strings escaped; 2: backslashes too, which always parses back."""
    if level == 2:
        text = text.replace("\\", "\\\\")
    return control.sub(lambda m: "\\" + m[0], text) if level else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str, level: int) -> tuple[str, int, int]:
    """A turn and the span of its text inside it."""
    if role == "user":
        head, tail = USER, USER_END
    elif role == "assistant":
        head, tail = ASSISTANT, ASSISTANT_END
    else:
        head, tail = ROLE + escape(role, level, NAME_CONTROL) + ROLE_END, TURN_END
    body = escape(text, level)
    return head + body + tail, len(head), len(head) + len(body)


def _plain(text: str, at: int, closing: str, step: re.Pattern = _STEP) -> int:
    """Where the plain text from ``at`` on ends: in front of ``closing``, at the first control string."""
    mark = closing.strip()
    for m in step.finditer(text, at):
        if m[1] is not None:
            continue
        if m[0] != mark and not (mark.startswith(m[0]) and text.startswith(mark, m.start())):
            raise ValueError(f"unexpected {m[0]!r}")
        lead = len(closing) - len(closing.lstrip())
        if m.start() - lead < at or not text.startswith(closing, m.start() - lead):
            raise ValueError("closing string without its space")
        return m.start() - lead
    raise ValueError("turn without an end")


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted conversation: role, plain text, and the span of the text as written."""
    turns, at = [], 0
    while at < len(text):
        if text.startswith(USER, at):
            role, start, closing = "user", at + len(USER), USER_END
        elif text.startswith(ROLE, at):
            stop = _plain(text, at + len(ROLE), ROLE_END, _NAME_STEP)
            role, start, closing = unescape(text[at + len(ROLE):stop]), stop + len(ROLE_END), TURN_END
        elif text.startswith(ASSISTANT, at):
            role, start, closing = "assistant", at + len(ASSISTANT), ASSISTANT_END
        else:
            raise ValueError(f"no turn starts at {at}")
        stop = _plain(text, start, closing)
        turns.append((role, unescape(text[start:stop]), start, stop))
        at = stop + len(closing)
    return turns


def format_turn(role: str, text: str) -> tuple[str, int, int, int]:
    """Rendered turn, span of its text, and the level of escaping at which it parses back to itself."""
    for level in (0, 1, 2):
        out, start, stop = render(role, text, level)
        try:
            if parse(out) == [(role, text, start, stop)]:
                return out, start, stop, level
        except ValueError:
            pass
    raise ValueError("a fully escaped turn must parse back")


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per turn: id, turn, ``segment``, ``loss_start``, ``loss_stop`` (null unless assistant), ``escapes``.

    The text of a conversation is its segments in order of turn (null first), ties by segment.
    The loss span lies inside the segment. Null role or text is the empty one; null ids are one
    conversation. Rows that repeat stay. No shuffle, so no conversation is gathered.
    """
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"),
                        F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turn(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            learnt = [r == "assistant" for r in batch.column("role").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("turn"), pa.array([m[0] for m in made], pa.string()),
                 pa.array([m[1] if x else None for m, x in zip(made, learnt)], pa.int64()),
                 pa.array([m[2] if x else None for m, x in zip(made, learnt)], pa.int64()),
                 pa.array([m[3] for m in made], pa.int32())],
                names=["id", "turn", "segment", "loss_start", "loss_stop", "escapes"])
    out = rows.mapInArrow(run, f"id {kinds['id']}, turn {kinds['turn']}, segment string, loss_start bigint, "
                               "loss_stop bigint, escapes int")
    return out.withColumnsRenamed({"id": id_col, "turn": turn_col})


def read_chats(segments: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Digests of formatted conversations: id, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``,
    ``formatted_chars``, ``n_escaped``.

    A digest over a conversation is sequential by nature, so its turns pass one task; they
    stream through it in sorted order and only the state of the digests is held.
    """
    rows = segments.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), "segment", "loss_start",
                           "loss_stop", "escapes")
    id_type = rows.schema["id"].dataType.simpleString()
    ordered = rows.repartition("id").sortWithinPartitions("id", "turn", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def fold(rows):
            columns = list(zip(*rows)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], ids), *[pa.array(columns[i], pa.string() if i in (2, 4) else pa.int64())
                                              for i in range(1, 7)]],
                names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_escaped"])
        for batch in batches:
            ids = batch.column("id").type
            for row in zip(*[batch.column(c).to_pylist() for c in
                             ("id", "segment", "loss_start", "loss_stop", "escapes")]):
                if now is None or now[0] != row[0]:
                    if now:
                        done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]))
                    now = [row[0], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text, _, _ in parse(row[1]):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                if row[2] is not None:
                    learnt = unescape(row[1][row[2]:row[3]])
                    now[3] += len(learnt)
                    now[4].update(learnt.encode())
                now[5] += len(row[1])
                now[6] += row[4] > 0
            if len(done) >= 1000:
                yield fold(done)
                done = []
        if now:
            done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]))
        if done:
            yield fold(done)
    out = ordered.mapInArrow(run, f"id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                  "loss_sha256 string, formatted_chars bigint, n_escaped bigint")
    return out.withColumnRenamed("id", id_col)


def chat_round_trip(turns: DataFrame) -> DataFrame:
    """Format, write, and read back from what was written."""
    return read_chats(written(format_chats(turns), workspace(turns.sparkSession), "formatted"))
