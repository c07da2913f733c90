"""Bytes, words and hashes of Arrow text columns, computed by numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bytes that separate words: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

SLICE_BYTES = 4 << 20

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_FINISH = np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def digest_halves(text: str) -> tuple[Column, Column]:
    """128 bits of a text as two longs, which tell texts of one id apart; null counts as empty."""
    digest = F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))
    halves = F.left(digest, F.lit(16)), F.right(digest, F.lit(16))
    # never null, so that no join adds a filter and plans can share an exchange
    return tuple(F.coalesce(F.conv(h, 16, -10).cast("long"), F.lit(0).cast("long")) for h in halves)


def document_facts(docs: DataFrame, text: str, id: str) -> tuple[int, int]:
    """Bytes of all texts, and the most different texts that one id stands for.

    Where every id has one text, ids alone tell documents apart, and the
    entries need not carry the digest of a text.
    """
    check, more = digest_halves(text)
    key = F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(-(2**63))).alias("id")
    rows = docs.select(key, check.alias("check"), more.alias("more"), F.octet_length(f"`{text}`").alias("bytes"))
    texts = rows.groupBy("id", "check", "more").agg(F.sum("bytes").alias("bytes"))
    ids = texts.groupBy("id").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("texts"))
    size, most = ids.agg(F.sum("bytes"), F.max("texts")).first()
    return size or 0, most or 0


def numbered(ids: np.ndarray, check: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different document, in order, and the number of the document at every place."""
    order = np.lexsort((more, check, ids))
    differs = np.ones(len(order), bool)
    differs[1:] = False
    for x in (ids, check, more):
        s = x[order]
        differs[1:] |= s[1:] != s[:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(differs) - 1
    return order[differs], number


def document_range(ids: np.ndarray, check: np.ndarray, parts: int) -> np.ndarray:
    """The group of a document among ``parts``; texts of one id are spread."""
    spread = mix(ids.view(np.uint64) ^ mix(np.ascontiguousarray(check).view(np.uint64)))
    return ((spread >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled; a permutation of the 64-bit values."""
    x = x * _MULTIPLY
    x ^= x >> np.uint64(32)
    x *= _FINISH
    x ^= x >> np.uint64(29)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    if content is None or not len(column):
        return np.zeros(0, np.uint8), offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    data = np.frombuffer(content, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def to_array(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The inverse of ``buffers``."""
    large = pa.large_string() if kind == pa.string() else pa.large_binary()
    whole = pa.Array.from_buffers(
        large, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    )
    return whole.cast(kind)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` bytes of text; a longer text is alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        after = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(first, after - first)
        first = after


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each row (with the total last)."""
    inside = ~SPACE[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    tails = offsets[1:][offsets[1:] > 0] - 1
    stops[tails] = inside[tails]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) + np.uint64(seed))
    if len(starts):
        h = mix(h ^ (eights[starts] & _MASKS[np.minimum(left, 8)]))
    active, step = np.flatnonzero(left > 8), 8
    while len(active):
        rest = left[active] - step
        h[active] = mix(h[active] ^ (eights[starts[active] + step] & _MASKS[np.minimum(rest, 8)]))
        step += 8
        active = active[rest > 8]
    return h


def window_hashes(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2**64 of every ``size`` consecutive values.

    A window is put together from windows of a power of two of values, each
    made from two of half its size, so the work does not grow with ``size``
    but with its number of binary digits.
    """
    if len(values) < size:
        return np.zeros(0, np.uint64)
    power, length, block = np.uint64(base | 1), 1, values
    out, covered = None, 0
    with np.errstate(over="ignore"):
        while True:
            if size & length:
                if out is None:
                    out = block
                else:
                    n = len(values) - covered - length + 1
                    out = out[:n] * power + block[covered : covered + n]
                covered += length
            if covered == size:
                return out
            block = block[:-length] * power + block[length:]
            power, length = power * power, 2 * length


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def planes(values: np.ndarray) -> bytes:
    """Integers as planes of bytes: planes of small numbers are zeros, which shuffles compress."""
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type | str, width: int | None = None) -> np.ndarray:
    """The inverse of ``planes``; ``width`` planes if the highest ones were left out."""
    kind = np.dtype(kind)
    width = width or kind.itemsize
    rows = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((rows.shape[1], kind.itemsize), np.uint8)
    out[:, :width] = rows.T
    return out.reshape(-1).view(kind)
