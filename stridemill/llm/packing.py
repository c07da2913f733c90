"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.llm.text import buffers, gather, to_array, word_spans
from stridemill.schema import require_columns

CAPACITIES = (512, 1024, 2048, 4096)
#: What a task packs at a time: bounds its memory, and is far more than a sequence holds.
BLOCK_ROWS = 20_000
BLOCK_BYTES = 16 << 20

_PLACED = "sequence_id LONG, capacity INT, used INT, place INT, piece INT, start LONG, length INT"


def _checked(capacities: Sequence[int], costs: Mapping[int, float] | None) -> tuple[list[int], dict[int, float]]:
    sizes = sorted(set(capacities))
    if not sizes or sizes[0] < 1:
        raise ValueError("capacities must be positive")
    price = {c: float(c) for c in sizes} if costs is None else {c: float(costs[c]) for c in sizes}
    if min(price.values()) <= 0:
        raise ValueError("costs must be positive")
    return sizes, price


def best_fit(
    lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES, costs: Mapping[int, float] | None = None
) -> dict[str, np.ndarray]:
    """Pieces of the items (``item``, ``piece``, ``start``, ``length``) with their ``bin``,
    ``place`` in it, and the bin's ``capacity`` and ``used`` length.

    An item above the largest capacity is cut into pieces of that size and a
    rest. Pieces go in by falling length (ties: order of the items) to the open
    bin with the least room that takes them. If none does, the size is opened
    whose cost per unit of expected contents is least (ties: the smaller size);
    expected are the piece itself and as many of the smaller pieces still to
    come as the room takes. In the end every bin goes to the cheapest size that
    holds its contents.
    """
    sizes, price = _checked(capacities, costs)
    largest = sizes[-1]
    lengths = np.asarray(lengths, np.int64)
    count = np.maximum(1, -(-lengths // largest))
    item = np.repeat(np.arange(len(lengths)), count)
    piece = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    start = piece * largest
    length = np.minimum(lengths[item] - start, largest)
    order = np.argsort(-length, kind="stable")
    waiting = np.bincount(length, minlength=largest + 1) * np.arange(largest + 1)
    fits = np.cumsum(waiting)  # units of pieces up to each length, taken once at the start
    later = np.cumsum(length[order][::-1])[::-1]  # units not placed yet, the piece itself included
    bins = np.zeros(len(item), np.int64)
    place = np.zeros(len(item), np.int64)
    used: list[int] = []
    opened: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(largest + 1)]
    rooms = 0  # bit r: a bin with room r is open
    for k, at in enumerate(order.tolist()):
        need = int(length[at])
        above = rooms >> need
        if above:
            room = need + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            left = int(later[k]) - need

            def cost(c: int) -> float:
                more = min(c - need, left, int(fits[c - need]))
                return price[c] / max(need + more, 1)

            room = min((c for c in sizes if c >= need), key=lambda c: (cost(c), c))
            b = len(used)
            used.append(0)
            opened.append(room)
        bins[at], place[at] = b, used[b]
        used[b] += need
        if room - need:
            by_room[room - need].append(b)
            rooms |= 1 << (room - need)
    content = np.array(used, np.int64)
    cheapest = np.zeros(largest + 1, np.int64)
    for c in sorted(sizes, key=lambda c: (-price[c], -c)):
        cheapest[: c + 1] = c
    final = cheapest[content] if len(content) else content
    return {
        "item": item, "piece": piece, "start": start, "length": length, "bin": bins, "place": place,
        "capacity": final[bins], "used": content[bins],
    }


def _blocks(batches: Iterator[pa.RecordBatch], column: str | None, rows: int, size: int) -> Iterator[pa.Table]:
    """Runs of rows that a task packs together."""
    held: list[pa.RecordBatch] = []
    n = weight = 0
    for batch in batches:
        weights = (
            pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            if column
            else np.zeros(batch.num_rows, np.int64)
        )
        first = 0
        total = np.cumsum(weights)
        while first < batch.num_rows:
            before = total[first - 1] if first else 0
            last = int(np.searchsorted(total, before + size - weight, "right"))
            last = min(first + rows - n, max(last, first + (n == 0)), batch.num_rows)
            if last > first:
                held.append(batch.slice(first, last - first))
                n += last - first
                weight += int(total[last - 1] - before)
                first = last
            if first < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, n, weight = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _number(first: int, packed: dict[str, np.ndarray]) -> tuple[list[pa.Array], int]:
    """Columns of ``_PLACED`` for the pieces; sequences are numbered from ``first``."""
    made = int(packed["bin"].max()) + 1 if len(packed["bin"]) else 0
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
    values = [packed["bin"] + first, *[packed[c] for c in ("capacity", "used", "place", "piece", "start", "length")]]
    return [pa.array(v, k) for v, k in zip(values, kinds)], first + made


def pack_documents(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    capacities: Sequence[int] = CAPACITIES,
    costs: Mapping[int, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Every document in pieces, packed into sequences of the permitted lengths.

    The unit is a word (a run of bytes other than space and 0x09-0x0D) and one
    end mark for each document; ``costs`` are per sequence of a capacity, by
    default the capacity. Each task packs blocks of its own rows, so no text is
    moved, and a block holds at most ``block_rows`` rows and ``block_bytes`` of
    text (or one longer text).

    One row per piece: ``id``, ``sequence_id``, ``capacity``, ``used`` (units in
    the sequence), ``place`` (of the piece in the sequence), ``piece`` (number
    in the document), ``start`` and ``length`` (units of the document),
    ``text`` (of the piece, without white space around it; the end mark stands
    for no text). A null or empty text has only its end mark. Repeated rows are
    packed one by one; a null id stays null.
    """
    require_columns(docs, text, id)
    _checked(capacities, costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = TaskContext.get().partitionId() << 40
        for block in _blocks(batches, "text", block_rows, block_bytes):
            data, offsets = buffers(block.column("text"))
            begin, end, first = word_spans(data, offsets)
            packed = best_fit(np.diff(first) + 1, capacities, costs)
            columns, numbered = _number(numbered, packed)
            item = packed["item"]
            words = np.diff(first)[item]
            a = np.minimum(packed["start"], words)
            b = np.minimum(packed["start"] + packed["length"], words)
            some = b > a
            low, high = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
            low[some] = begin[(first[:-1][item] + a)[some]]
            high[some] = end[(first[:-1][item] + b - 1)[some]]
            ids = block.column("id").combine_chunks().take(pa.array(item))
            pieces = [ids, *columns, to_array(gather(data, low, high - low), np.r_[0, np.cumsum(high - low)], pa.string())]
            made = pa.RecordBatch.from_arrays(pieces, _NAMES)
            yield from (made.slice(k, 5000) for k in range(0, made.num_rows, 5000))

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {_PLACED}, text STRING").withColumnRenamed("id", id)


_NAMES = ["id", "sequence_id", "capacity", "used", "place", "piece", "start", "length", "text"]


def pack_lengths(
    rows: DataFrame,
    length: str = "length",
    id: str = "doc_id",
    capacities: Sequence[int] = CAPACITIES,
    costs: Mapping[int, float] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``pack_documents`` for rows that have only a length: no text column.

    A null or negative length counts as zero; such an item still has one piece.
    """
    require_columns(rows, length, id)
    _checked(capacities, costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = TaskContext.get().partitionId() << 40
        for block in _blocks(batches, None, block_rows, 1):
            packed = best_fit(block.column("length").to_numpy(), capacities, costs)
            columns, numbered = _number(numbered, packed)
            ids = block.column("id").combine_chunks().take(pa.array(packed["item"]))
            yield pa.RecordBatch.from_arrays([ids, *columns], _NAMES[:-1])

    kind = rows.schema[id].dataType.simpleString()
    needed = rows.select(
        F.col(f"`{id}`").alias("id"),
        F.greatest(F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(0)), F.lit(0)).alias("length"),
    )
    return needed.mapInArrow(run, f"id {kind}, {_PLACED}").withColumnRenamed("id", id)
