"""Chat formatting: conversations as text with marked turns, assembled as whole columns of bytes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.llm.text import SLICE_BYTES, buffers, slices, to_array
from stridemill.schema import require_columns

#: The control strings. A turn is ``<s>[INST] role [/INST]text</s>``.
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
#: A control string, or one that escaping has already pushed apart by backslashes.
_CONTROL = r"([<\[])(\\*)(s>|/s>|INST\]|/INST\])"
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(CLOSE), re.S)
#: Bytes of formatted text in one row; a longer conversation goes on in the next part.
PART_BYTES = 8 << 20

_OUT = "conv LONG, part INT, n_turns LONG, formatted STRING, loss_spans ARRAY<STRUCT<start: LONG, end: LONG>>"


def escape(column: pa.Array) -> pa.Array:
    """A backslash behind the first character of every control string; null is empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.replace_substring_regex(filled, _CONTROL, r"\1\\\2\3")


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return re.sub(r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\])", r"\1\2\3", text)


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> None:
    """Put consecutive pieces of ``data`` to their places in ``out``."""
    before = np.cumsum(lengths) - lengths
    out[np.repeat(at - before, lengths) + np.arange(len(data))] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns, their offsets, and where each turn's text starts and ends.

    Lengths of all segments give the offsets, offsets the places; headers and
    contents are copied once into one preallocated buffer.
    """
    role, role_at = buffers(escape(roles))
    text, text_at = buffers(escape(texts))
    a, b, c = (np.frombuffer(s.encode(), np.uint8) for s in (OPEN, MIDDLE, CLOSE))
    n_role, n_text = np.diff(role_at), np.diff(text_at)
    offsets = np.r_[0, np.cumsum(len(a) + n_role + len(b) + n_text + len(c))]
    out = np.empty(offsets[-1], np.uint8)
    at = offsets[:-1]
    out[at[:, None] + np.arange(len(a))] = a
    at = at + len(a)
    _scatter(out, at, role, n_role)
    at = at + n_role
    out[at[:, None] + np.arange(len(b))] = b
    start = at + len(b)
    _scatter(out, start, text, n_text)
    end = start + n_text
    out[end[:, None] + np.arange(len(c))] = c
    return out, offsets, start, end


_ROWS = pa.schema([("conv", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _columns(rows: pa.Table, cuts: np.ndarray, numbers: np.ndarray, loss_role: str) -> tuple[pa.RecordBatch, np.ndarray]:
    """The parts that begin at the rows ``cuts`` (with the end last), all columns made from offsets
    into the one buffer of their text; and the bytes of each part."""
    data, offsets, start, end = assemble(rows.column("role"), rows.column("text"))
    # code points before each byte: bytes that begin a character
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    roles = rows.column("role").combine_chunks()
    mask = pc.fill_null(pc.equal(roles, loss_role), False).to_numpy(zero_copy_only=False)
    part = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[mask]
    before = chars[offsets[cuts[:-1]]][part]
    spans = pa.StructArray.from_arrays([pa.array(chars[x[mask]] - before) for x in (start, end)], fields=list(_SPAN))
    lists = np.searchsorted(part, np.arange(len(cuts))).astype(np.int32)
    made = pa.RecordBatch.from_arrays(
        [
            rows.column("conv").combine_chunks().take(pa.array(cuts[:-1])), pa.array(numbers, pa.int32()), pa.array(np.diff(cuts)),
            to_array(data, offsets[cuts], pa.string()), pa.ListArray.from_arrays(pa.array(lists), spans),
        ],
        ["conv", "part", "n_turns", "formatted", "loss_spans"],
    )
    return made, np.diff(offsets[cuts])


def _format(loss_role: str, part_bytes: int):
    """Rows come sorted by conversation and turn; a conversation may go over many batches.

    The rows of the last conversation of a slice wait for the next slice, unless
    they make a whole part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, conv, number = _ROWS.empty_table(), None, 0
        for batch in batches:
            for rows in slices(batch, "text", min(SLICE_BYTES, part_bytes)):
                table = pa.concat_tables([waiting, pa.Table.from_batches([rows]).cast(_ROWS)])
                convs = table.column("conv").to_pylist()
                cuts = np.array([k for k in range(len(convs)) if k == 0 or convs[k] != convs[k - 1]] + [len(convs)])
                numbers = np.zeros(len(cuts) - 1, np.int32)
                if number and convs[0] == conv:
                    numbers[0] = number
                made, sizes = _columns(table, cuts, numbers, loss_role)
                whole = len(sizes) if sizes[-1] >= part_bytes else len(sizes) - 1
                if whole:
                    yield made.slice(0, whole)
                conv, number = convs[-1], int(numbers[-1]) + (whole == len(sizes))
                waiting = table.slice(cuts[whole])
        if waiting.num_rows:
            yield _columns(waiting, np.array([0, waiting.num_rows]), np.array([number]), loss_role)[0]

    return run


def format_conversations(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_role: str = "assistant",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """One text per conversation, and the spans of it that a loss counts.

    Every turn is ``<s>[INST] role [/INST]text</s>``; a control string inside a
    role or text gets a backslash behind its first character (one more if it
    has some already), so a text can hold anything and is read back unchanged.

    Result: ``conv``, ``part`` (from 0; a conversation above ``part_bytes`` goes
    on in further parts, cut between turns), ``n_turns``, ``formatted`` and
    ``loss_spans`` (code points of the part, end exclusive: the escaped texts of
    ``loss_role``). Turns are sorted by ``turn``, then role and text; repeated
    rows are repeated turns. Null roles and texts are empty, null turns come
    first, the null conversation is one of its own. Rows are dealt by
    conversation and streamed, so a task holds one part, not a conversation.
    """
    require_columns(turns, conv, turn, role, text)
    if conv in ("part", "n_turns", "formatted", "loss_spans"):
        raise ValueError(f"the conversation column cannot be named {conv}")
    rows = turns.select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"),
    )
    out = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return out.select("conv", "role", "text").mapInArrow(_format(loss_role, part_bytes), _OUT).withColumnRenamed("conv", conv)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of the turns of a part."""
    found, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at character {at}")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return found


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss = conv, 0, 0, 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, row: dict) -> None:
        for role, text in parse(row["formatted"]):
            self.turn_hash.update(f"{role}\n{text}\n".encode())
            self.turns += 1
        self.chars += len(row["formatted"])
        for span in row["loss_spans"]:
            text = unescape(row["formatted"][span["start"] : span["end"]])
            self.loss += len(text)
            self.loss_hash.update(text.encode())

    def row(self) -> dict:
        return {
            "conv": self.conv, "n_turns": self.turns, "turns_sha256": self.turn_hash.hexdigest(), "loss_chars": self.loss,
            "loss_sha256": self.loss_hash.hexdigest(), "formatted_chars": self.chars,
        }


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema(list(zip(names, kinds)))
    digest, done = None, []
    for batch in batches:
        for row in (r for part in slices(batch, "formatted") for r in part.to_pylist()):
            if digest is None or digest.conv != row["conv"]:
                if digest is not None:
                    done.append(digest.row())
                digest = _Digest(row["conv"])
            digest.add(row)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if digest is not None:
        yield pa.RecordBatch.from_pylist([digest.row()], schema)


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of what the formatted parts say, parsed and unescaped.

    ``n_turns``, ``turns_sha256`` (role, line feed, text, line feed of each
    turn), ``loss_chars`` and ``loss_sha256`` (all text under the loss spans),
    ``formatted_chars``. Parts are read in order and hashed as they come.
    """
    rows = formatted.select(F.col(f"`{conv}`").alias("conv"), "part", "formatted", "loss_spans")
    rows = rows.repartition("conv").sortWithinPartitions("conv", "part").drop("part")
    return rows.mapInArrow(
        _digest,
        "conv LONG, n_turns LONG, turns_sha256 STRING, loss_chars LONG, loss_sha256 STRING, formatted_chars LONG",
    ).withColumnRenamed("conv", conv)
