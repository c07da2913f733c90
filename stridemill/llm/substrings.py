"""Removal of repeated token windows by Rabin-Karp hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.llm.text import (
    buffers,
    digest_halves,
    document_facts,
    document_range,
    from_planes,
    gather,
    hash_spans,
    mix,
    numbered,
    planes,
    slices,
    to_array,
    window_hashes,
    word_spans,
)
from stridemill.schema import require_columns

#: Odd bases of the two window hashes; fixed so that all tasks agree.
BASES = (0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407)
#: Windows that a task sorts at a time.
BLOCK_WINDOWS = 500_000
#: Bytes of text whose windows meet in one group.
GROUP_BYTES = 8 << 20
_NO_ID = -(2**63)
_ENTRIES = "part INT, ids BINARY, checks BINARY, mores BINARY, counts BINARY, starts BINARY, hashes BINARY"
_FOUND = "id LONG, check LONG, more LONG, found BINARY"
_SCHEMA = pa.schema(
    [("part", pa.int32())] + [(c, pa.binary()) for c in ("ids", "checks", "mores", "counts", "starts", "hashes")]
)

#: Ids and digest halves of documents.
Documents = tuple[np.ndarray, np.ndarray, np.ndarray]


def _cuts(keys: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.r_[np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])
    return list(zip(at.tolist(), np.r_[at[1:], len(keys)].tolist()))


def _row(part: int, docs: Documents, doc: np.ndarray, starts: np.ndarray, hashes: np.ndarray | None = None) -> dict:
    """The entries of a part in order of document and start, packed; ``doc`` numbers ``docs``."""
    first = np.r_[True, doc[1:] != doc[:-1]]
    new = np.flatnonzero(first)
    gaps = np.where(first, starts, starts - np.r_[0, starts[:-1]])
    ids, checks, mores = (x[doc[new]] for x in docs)
    return {
        "part": part,
        "ids": planes(np.diff(ids, prepend=0)),
        "checks": planes(checks),
        "mores": planes(mores),
        "counts": planes(np.diff(np.r_[new, len(doc)]).astype(np.uint32)),
        "starts": planes(gaps.astype(np.uint32)),
        "hashes": b"" if hashes is None else planes(hashes),
    }


def _unpack(row: dict) -> tuple[Documents, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, how many entries each has, and the entries' starts and hashes."""
    counts = from_planes(row["counts"], np.uint32).astype(np.int64)
    docs = (np.cumsum(from_planes(row["ids"], np.int64)), from_planes(row["checks"], np.int64), from_planes(row["mores"], np.int64))
    gaps = from_planes(row["starts"], np.uint32).astype(np.int64)
    total = np.cumsum(gaps)
    before = np.cumsum(counts) - counts
    starts = total - np.repeat(total[before] - gaps[before], counts) if len(gaps) else total
    return docs, counts, starts, from_planes(row["hashes"], np.uint64)


def _merged(rows: list[tuple]) -> tuple[Documents, np.ndarray, np.ndarray]:
    """The different documents of unpacked rows in order, and number and start of all entries."""
    docs = tuple(np.concatenate([r[0][k] for r in rows]) for k in range(3))
    chosen, number = numbered(*docs)
    doc = np.repeat(number, np.concatenate([r[1] for r in rows]))
    return tuple(x[chosen] for x in docs), doc, np.concatenate([r[2] for r in rows])


def _later(hashes: list[np.ndarray], doc: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the entries: is it the first of its hash, and does it stand after the first.

    Equal entries (rows given twice) count as one position: none is after the other.
    """
    order = np.lexsort((starts, doc, *hashes))
    differs = np.zeros(len(order), bool)
    for h in hashes:
        s = h[order]
        differs[1:] |= s[1:] != s[:-1]
    differs[:1] = True
    head = np.maximum.accumulate(np.where(differs, np.arange(len(order)), 0))
    same = np.ones(len(order), bool)
    for x in (doc, starts):
        s = x[order]
        same &= s == s[head]
    first, after = np.zeros(len(order), bool), np.zeros(len(order), bool)
    first[order] = differs
    after[order] = ~same
    return first, after


def _twice(values: np.ndarray) -> np.ndarray:
    """Places of values that occur more than once."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    twice = np.zeros(len(s), bool)
    twice[1:] = s[1:] == s[:-1]
    twice[:-1] |= twice[1:].copy()
    return order[twice]


def _by_part(part: np.ndarray, docs: Documents, doc: np.ndarray, starts: np.ndarray, hashes: np.ndarray | None = None) -> Iterator[dict]:
    order = np.lexsort((starts, doc, part))
    part, doc, starts = part[order], doc[order], starts[order]
    hashes = hashes if hashes is None else hashes[order]
    for a, b in _cuts(part):
        yield _row(int(part[a]), docs, doc[a:b], starts[a:b], hashes if hashes is None else hashes[a:b])


def _entries(window: int, parts: int, block: int):
    """Windows of each block by hash range; a window that repeats in the block is sent once.

    Its later places in the block are settled, and go by document.
    """

    def flush(held: list[tuple], texts: list[Documents]) -> Iterator[pa.RecordBatch]:
        high, low, row, starts = (np.concatenate(x) for x in zip(*held))
        docs = tuple(np.concatenate(x) for x in zip(*texts))
        held.clear()
        texts.clear()
        chosen, number = numbered(*docs)
        docs, doc = tuple(x[chosen] for x in docs), number[row]
        at = _twice(low)
        first, after = _later([low[at], high[at]], doc[at], starts[at])
        gone = at[after]
        keep = np.ones(len(low), bool)
        keep[at] = first
        kept = np.flatnonzero(keep)
        rows = list(_by_part(document_range(docs[0], docs[1], parts)[doc[gone]], docs, doc[gone], starts[gone]))
        part = ((high[kept] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        rows += _by_part(part, docs, doc[kept], starts[kept], low[kept])
        for k in range(0, len(rows), 64):
            yield pa.RecordBatch.from_pylist(rows[k : k + 64], _SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        texts: list[Documents] = []
        size = known = 0
        for batch in batches:
            for rows in slices(batch, "text", 2 << 20):
                data, offsets = buffers(rows.column("text"))
                begin, end, first = word_spans(data, offsets)
                counts = np.maximum(np.diff(first) - window + 1, 0)
                if not counts.sum():
                    continue
                words = hash_spans(data, begin, end)
                starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                at = np.repeat(first[:-1], counts) + starts
                low = window_hashes(words, window, BASES[0])[at]
                high = mix(window_hashes(mix(words ^ np.uint64(BASES[1])), window, BASES[1])[at])
                held.append((high, low, np.repeat(np.arange(known, known + rows.num_rows), counts), starts))
                texts.append(tuple(rows.column(c).to_numpy() for c in ("id", "check", "more")))
                size, known = size + len(at), known + rows.num_rows
                if size >= block:
                    yield from flush(held, texts)
                    size = known = 0
        if size:
            yield from flush(held, texts)

    return run


def _repeats(targets: int):
    """The windows of one hash range that stand after an equal one, packed by target group of documents."""

    def run(table: pa.Table) -> pa.Table:
        rows = [_unpack(row) for row in table.to_pylist()]
        out = []
        for settled in (True, False):
            mine = [r for r in rows if (not len(r[3])) == settled]
            if not mine:
                continue
            docs, doc, starts = _merged(mine)
            if not settled:
                hashes = np.concatenate([r[3] for r in mine])
                at = _twice(hashes)
                at = at[_later([hashes[at]], doc[at], starts[at])[1]]
                doc, starts = doc[at], starts[at]
            out += _by_part(document_range(docs[0], docs[1], targets)[doc], docs, doc, starts)
        return pa.Table.from_pylist(out, _SCHEMA)

    return run


def _by_document(table: pa.Table) -> pa.Table:
    """The repeated windows of a target group of documents, one row per document."""
    docs, doc, starts = _merged([_unpack(row) for row in table.to_pylist()])
    order = np.lexsort((starts, doc))
    doc, starts = doc[order], starts[order].astype(np.int32)
    ends = np.searchsorted(doc, np.arange(len(docs[0]) + 1)) * 4
    columns = [pa.array(x) for x in docs] + [to_array(starts.view(np.uint8), ends, pa.binary())]
    return pa.Table.from_arrays(columns, ["id", "check", "more", "found"])


def _cut(window: int):
    """Words covered by a repeated window leave the text; the rest is joined by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", 2 << 20):
                data, offsets = buffers(rows.column("text"))
                begin, end, first = word_spans(data, offsets)
                change = np.zeros(len(begin) + 1, np.int32)
                raw, places = buffers(rows.column("found"))
                starts = np.ascontiguousarray(raw).view(np.int32).astype(np.int64)
                starts += np.repeat(first[:-1], np.diff(places) // 4)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
                edge_at = np.zeros(len(begin) + 1, bool)
                edge_at[first] = True  # spans end with their document
                opens = np.flatnonzero(gone & ((edge[:-1] > 0) | edge_at[:-1]))
                closes = np.flatnonzero(gone & ((edge[1:] < 0) | edge_at[1:])) + 1
                kept = np.flatnonzero(~gone)
                kept_first = np.searchsorted(kept, first)
                length = (end - begin)[kept] + 1  # with the space behind
                padded = np.concatenate([data, np.array([32], np.uint8)])
                out = gather(padded, begin[kept], length)
                stops = np.cumsum(length)
                out[stops - 1] = 32
                bounds = np.r_[0, stops][kept_first]
                some = np.diff(kept_first) > 0
                drop = bounds[1:][some] - 1  # no space behind the last word
                live = np.ones(len(out), bool)
                live[drop] = False
                places = bounds - np.r_[0, np.cumsum(some)]
                span_first = np.searchsorted(opens, first)
                own = np.repeat(first[:-1], np.diff(span_first))
                spans = pa.ListArray.from_arrays(
                    pa.array(span_first, pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array(opens - own), pa.array(closes - own)], ["start", "end"]
                    ),
                )
                removed = np.diff(np.r_[0, np.cumsum(gone)][first])
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("row"),
                        to_array(out[live], places, pa.string()),
                        pa.array(np.diff(first)),
                        pa.array(removed),
                        spans,
                    ],
                    ["row", "text", "n_words", "n_removed", "spans"],
                )

    return run


def remove_repeated_windows(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    window: int = 20,
    group_bytes: int = GROUP_BYTES,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Cut every word that lies in a window of ``window`` words seen earlier.

    Earlier means in a smaller id, or before in the same document. Words are
    runs of bytes other than space and 0x09-0x0D; windows are judged on the
    input. Every window is hashed (Rabin-Karp, 64 bits and the hash range it
    falls in, so the hash grows with the number of ranges). Blocks of windows
    send a repeated window once, so no hash range holds more of one window than
    there are blocks; its other places in the block are settled and go by
    document. Repeated windows come back per document and merge into maximal
    spans.

    Result: the columns of ``docs``, the text replaced by the kept words joined
    by one space, and ``n_words``, ``n_removed``, ``spans`` (word positions
    ``start`` and ``end`` of the removed runs, end exclusive). Input columns
    with these names are replaced. Null text: no words. A null id sorts first. Rows that repeat
    id and text are one document and get one result each; rows of one id with
    different texts are different documents.
    """
    require_columns(docs, text, id)
    made = ["n_words", "n_removed", "spans"]
    if id in made or text in made:
        raise ValueError(f"id and text cannot be named like the results {made}")
    others = [c for c in docs.columns if c not in (text, *made)]
    size, texts = document_facts(docs, text, id)
    halves = digest_halves(text) if texts > 1 else [F.lit(0).cast("long")] * 2
    base = docs.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("row"),
        F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(_NO_ID)).alias("id"),
        F.col(f"`{text}`").alias("text"),
        *[half.alias(c) for half, c in zip(halves, ("check", "more"))],
    )
    parts = max(1, -(-size // group_bytes))
    entries = base.select("id", "check", "more", "text").mapInArrow(_entries(window, parts, block_windows), _ENTRIES)
    found = (
        entries.groupBy("part")
        .applyInArrow(_repeats(parts), _ENTRIES)
        .groupBy("part")
        .applyInArrow(_by_document, _FOUND)
    )
    joined = base.join(found, ["id", "check", "more"], "left").select("row", "text", "found")
    kind = joined.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(
        _cut(window),
        f"row {kind}, text STRING, n_words LONG, n_removed LONG, spans ARRAY<STRUCT<start: LONG, end: LONG>>",
    )
    kept = [F.col("text").alias(text) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c not in made]
    return out.select(*kept, *made)
