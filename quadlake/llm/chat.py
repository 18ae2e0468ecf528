"""Chat formatting by columnar byte assembly.

A batch of turns becomes one buffer: the lengths of all segments (header, content, footer)
are known first, their cumulative sums are the offsets, and headers, contents and footers
are scattered into one preallocated array that Arrow takes as it is. Control strings inside
texts are escaped reversibly: an escape character is doubled, and one is put behind the first
character of every control string, so that none stands in the output but the template's own.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed

#: The template's turn marks and the control strings of common chat templates.
HEAD, FOOT = b"<|turn|>", b"<|end|>"
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
ESCAPE = "\x1b"
#: Stands for a line break inside a role; no control string begins with n.
BREAK = "n" + ESCAPE
#: An escape character, or the first character of a control string.
_DANGER = re.compile("|".join([re.escape(ESCAPE), *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)]))


def escaped(text: str) -> str:
    return _DANGER.sub(lambda m: m[0] + ESCAPE, text) if _DANGER.search(text) else text


def restored(text: str) -> str:
    """Of a run of escape characters every other one stays; the odd one was put behind a first character."""
    return _RUN.sub(lambda m: ESCAPE * (len(m[0]) // 2), text) if ESCAPE in text else text


_RUN = re.compile(f"{ESCAPE}+")
_ROLE_RUN = re.compile(f"n?{ESCAPE}+")


def restored_role(role: str) -> str:
    """restored(), and line breaks, which are an n with an odd escape character."""
    return restored(_ROLE_RUN.sub(lambda m: "\n" + m[0][2:] if m[0][0] == "n" and len(m[0]) % 2 == 0 else m[0], role))


def assemble(segments: list[list[bytes]]) -> pa.Array:
    """Rows of joined segments: segments[c][r] is column c of row r; one copy into one buffer."""
    rows = len(segments[0])
    lengths = np.array([np.fromiter(map(len, s), np.int64, rows) for s in segments]).T.reshape(rows, len(segments))
    ends = np.cumsum(lengths.ravel())
    starts = (ends - lengths.ravel()).reshape(lengths.shape)
    buffer = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for c, column in enumerate(segments):
        source = np.frombuffer(b"".join(column), np.uint8)
        n = lengths[:, c]
        shift = starts[:, c] - (np.cumsum(n) - n)
        buffer[np.arange(len(source)) + np.repeat(shift, n)] = source
    offsets = np.zeros(rows + 1, np.int64)
    offsets[1:] = ends.reshape(lengths.shape)[:, -1] if rows else []
    return pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(buffer)])


def format_turns(turns: DataFrame, roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Each turn's formatted bytes, and where in them the loss applies (byte span of the content).

    Columns conv_id, turn, formatted, loss_start, loss_end; the span is empty for other roles.
    Null roles and texts count as empty; a role is escaped like a text; repeated rows are kept;
    an empty table gives an empty one; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                role = [x or "" for x in part.column(2).to_pylist()]
                names = [escaped(x).replace("\n", BREAK).encode() for x in role]
                content = [escaped(x or "").encode() for x in part.column(3).to_pylist()]
                n = len(role)
                out = assemble([[HEAD] * n, names, [b"\n"] * n, content, [FOOT] * n])
                start = np.fromiter(map(len, names), np.int64, n) + len(HEAD) + 1
                size = np.fromiter(map(len, content), np.int64, n)
                loss = np.fromiter((x in roles for x in role), bool, n)
                yield pa.record_batch([part.column(0), part.column(1), out.cast(pa.binary()), pa.array(start), pa.array(start + size * loss)], ["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(freed(run), "conv_id long, turn long, formatted binary, loss_start long, loss_end long")


def parse(formatted: bytes) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (formatted.startswith(HEAD) and formatted.endswith(FOOT)):
        raise ValueError("not a formatted turn")
    role, _, text = formatted[len(HEAD) : -len(FOOT)].decode().partition("\n")
    return restored_role(role), restored(text)


def conversation_digests(turns: DataFrame) -> DataFrame:
    """What reading the formatted turns of each conversation back gives.

    Columns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Turns are
    sorted by turn (null first, equal turns by their bytes) within a partition of whole
    conversations and hashed as they pass, so a long conversation is never held as a whole. Null
    roles and texts count as empty, rows without a conv_id are one conversation, repeated rows
    are turns of their own, an empty table gives an empty one, and other columns are not read.
    Line breaks in a role are escaped, so that it is read back whole.
    """

    def run(batches):
        state = None

        def row():
            conv, n, whole, chars, loss, size = state
            return [conv, n, whole.hexdigest(), chars, loss.hexdigest(), size]

        for batch in batches:
            out = []
            for conv, formatted, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(formatted)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if b > a:
                    masked = restored(formatted[a:b].decode())
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(formatted.decode())
            if out:
                yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), TYPES, strict=True)], FIELDS)
        if state is not None:
            yield pa.record_batch([pa.array([x], t) for x, t in zip(row(), TYPES, strict=True)], FIELDS)

    dealt = format_turns(turns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return dealt.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(freed(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


FIELDS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table, and conversation -7, whose texts hold control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    more = conversations.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)
