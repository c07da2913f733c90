"""Removal of repeated byte strings by suffix arrays of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.llm.text import (
    buffers, digest_halves, document_facts, document_range, from_planes, mix, numbered, planes, slices, to_array, window_hashes,
)
from stridemill.schema import require_columns

#: Bytes of text whose anchors, and later segments, meet in one group.
GROUP_BYTES = 8 << 20
#: Anchors, and bytes of distinct segments, that a task holds at a time.
BLOCK_ANCHORS = 200_000
BLOCK_BYTES = 8 << 20
#: Bytes of distinct segments in one suffix array; windows of an anchor with more go by their own hash.
ARRAY_BYTES = 1 << 20
#: Bytes of text, and least share of it, in which such anchors are looked for.
SAMPLE_BYTES = 64 << 20
SAMPLE_SHARE = 1 / 32
#: Most anchors that can be replaced by their windows; their hashes are broadcast (16 MB).
MOST_HOT = 1 << 21
#: Window starts looked at together in a long text.
CHUNK = 1 << 19
#: Largest alphabet that is sorted by induction.
INDUCED = 1024
_BASE = 0xB5026F5AA96619E9
_NO_ID = -(2**63)


# --- suffix arrays ----------------------------------------------------------------


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last counts as smaller."""
    n = len(s)
    step = np.sign(s[1:].astype(np.int64) - s[:-1])
    known = np.flatnonzero(step)
    at = np.searchsorted(known, np.arange(n - 1))
    smaller = np.ones(n, bool)
    inside = at < len(known)
    smaller[:-1][inside] = step[known[at[inside]]] > 0
    return smaller


def _place(array: np.ndarray, items: np.ndarray, symbols: np.ndarray, ends: np.ndarray, direction: int) -> None:
    """Append items to the buckets of their symbols, in order, upwards or downwards."""
    order = np.argsort(symbols, kind="stable")
    sym = symbols[order]
    new = np.flatnonzero(np.r_[True, sym[1:] != sym[:-1]])
    counts = np.diff(np.r_[new, len(sym)])
    rank = np.arange(len(sym)) - np.repeat(new, counts)
    array[ends[sym] + direction * rank] = items[order]
    ends[sym[new]] += direction * counts


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: int, unique: int) -> np.ndarray:
    """All suffixes from sorted leftmost-smaller ones; symbols below ``unique`` keep their given order.

    A bucket is not scanned entry by entry: all entries it has got so far put
    their predecessors in place at once. Those of the same symbol are the next
    entries of this bucket, so a bucket takes as many steps as its longest run.
    """
    counts = np.bincount(s, minlength=size)
    heads = np.cumsum(counts) - counts
    out = np.full(len(s), -1, np.int32)
    order = np.argsort(s[lms], kind="stable")
    grouped = lms[order]
    first = np.searchsorted(s[grouped], np.arange(size + 1))

    def before(items: np.ndarray, kind: bool) -> np.ndarray:
        items = items[items > 0] - 1
        items = items[smaller[items] == kind]
        return items[s[items] >= unique] if unique and kind else items

    # larger suffixes upwards, from the leftmost-smaller ones
    at = heads.copy()
    used = np.flatnonzero(counts)
    last = len(s) - 1
    if not smaller[last]:
        raise ValueError("the last symbol must be the smallest")
    for c in used.tolist():
        done = int(heads[c])
        while done < at[c]:
            wave = out[done : at[c]]
            done = int(at[c])
            items = before(wave, False)
            if len(items):
                _place(out, items, s[items], at, 1)
        items = before(grouped[first[c] : first[c + 1]], False)
        if len(items):
            _place(out, items, s[items], at, 1)
    larger_end = at
    # smaller suffixes downwards, from the larger ones
    tails = heads + counts - 1
    at = tails.copy()
    if unique:
        fixed = grouped[: first[unique]]
        out[: len(fixed)] = fixed
    else:
        out[at[s[last]]] = last
        at[s[last]] -= 1
    for c in used[::-1].tolist():
        if c < unique:
            break
        done = int(tails[c])
        while done > at[c]:
            wave = out[at[c] + 1 : done + 1][::-1]
            done = int(at[c])
            items = before(wave, True)
            if len(items):
                _place(out, items, s[items], at, -1)
        items = before(out[heads[c] : larger_end[c]][::-1], True)
        if len(items):
            _place(out, items, s[items], at, -1)
    return out


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray, unique: int) -> np.ndarray:
    """A number for each leftmost-smaller substring, equal ones alike, in text order.

    Substrings that begin with a symbol below ``unique`` are all different.
    """
    index = np.full(len(s) + 1, -1, np.int32)
    index[lms] = np.arange(len(lms))
    rank = index[ordered]
    length = np.diff(np.r_[lms, len(s) - 1]) + 1
    a, b = ordered[:-1], ordered[1:]
    same = (length[rank[:-1]] == length[rank[1:]]) & (s[a] == s[b]) & (s[a] >= unique)
    active, step = np.flatnonzero(same), 1
    while len(active):
        inside = step < length[rank[active]]
        active = active[inside]
        equal = s[a[active] + step] == s[b[active] + step]
        same[active[~equal]] = False
        active = active[equal]
        step += 1
    names = np.empty(len(lms), np.int64)
    names[rank] = np.r_[0, np.cumsum(~same)]
    return names


def _by_doubling(s: np.ndarray) -> np.ndarray:
    """Suffix order of a string over a large alphabet: ranks of doubling length."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.r_[0, s[order][1:] != s[order][:-1]])
    k = 1
    while n and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        k *= 2
    return order


def suffix_array(s: np.ndarray, size: int, unique: int = 0) -> np.ndarray:
    """Positions of the suffixes in order (induced sorting).

    The last symbol must be smaller than all others, or be among the symbols
    below ``unique``, which count as different wherever they stand, ordered by
    position. Suffixes are classified as smaller or larger than the next one;
    leftmost-smaller substrings are sorted by induction and named; the string
    of names is sorted recursively, by induction again while its alphabet has
    at most ``INDUCED`` symbols (a step per bucket would not pay above) and by
    doubling ranks beyond; then all suffixes are induced from that order.
    """
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    smaller = _types(s)
    if unique:
        smaller[s < unique] = True
    lms = np.flatnonzero(smaller & np.r_[False, ~smaller[:-1]])
    if not len(lms):
        return _by_doubling(s).astype(np.int32)
    first = _induce(s, smaller, lms, size, unique)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    names = _names(s, lms, ordered, unique)
    kinds = int(names.max()) + 1
    if kinds == len(lms):
        order = np.argsort(names, kind="stable")
    elif kinds <= INDUCED and names[-1] == 0 and (names == 0).sum() == 1:
        order = suffix_array(names.astype(np.int32), kinds)
    else:
        order = _by_doubling(names)
    return _induce(s, smaller, lms[order], size, unique)


def common_prefixes(
    s: np.ndarray, symbols: np.ndarray, order: np.ndarray, rest: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Permuted common prefixes: of each position with the one before it in suffix order, and that one.

    Only positions whose left neighbour differs from the other's are compared,
    eight bytes a step; from there on each next position has one less. ``rest``
    (bytes up to the next separator, symbol 0) bounds a prefix on both sides.
    """
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    left = np.flatnonzero((np.arange(n) == 0) | (phi <= 0))
    start = np.ones(n, bool)
    inner = np.setdiff1d(np.arange(n), left, assume_unique=True)
    start[inner] = (symbols[inner - 1] != symbols[phi[inner] - 1]) | (symbols[inner - 1] == 0)
    where = np.flatnonzero(start & (phi >= 0))
    eights = np.ndarray((n + 1,), "<u8", np.r_[s, np.zeros(8, np.uint8)], strides=(1,))
    length = np.zeros(len(where), np.int64)
    active = np.arange(len(where))
    bound = np.minimum(rest[where], rest[phi[where]])
    while len(active):
        a, b = where[active] + length[active], phi[where[active]] + length[active]
        differ = eights[a] ^ eights[b]
        equal = differ == 0
        # the lowest set bit tells the first byte that differs
        low = differ & (~differ + np.uint64(1))
        byte = np.where(equal, 8, (np.log2(np.maximum(low, 1).astype(np.float64)) // 8).astype(np.int64))
        length[active] += byte
        active = active[equal & (length[active] < bound[active])]
    value = np.zeros(n, np.int64)
    value[where] = np.minimum(length, bound) + where
    value = np.maximum.accumulate(np.where(start, value, 0))
    plcp = np.maximum(value - np.arange(n), 0)
    plcp[phi < 0] = 0
    return plcp, phi


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, at which starts the ``length`` bytes stand also elsewhere in the texts."""
    sizes = np.array([len(t) for t in texts])
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    s = joined.astype(np.int16) + 1
    s[ends] = 0
    order = suffix_array(s, 257, unique=1)
    rest = np.repeat(ends, sizes + 1) - np.arange(len(s))
    plcp, phi = common_prefixes(joined, s, order, rest)
    found = np.flatnonzero(plcp >= length)
    hit = np.zeros(len(s), bool)
    hit[found] = True
    hit[phi[found]] = True
    begins = ends - sizes
    return [hit[a : a + max(n - length + 1, 0)] for a, n in zip(begins.tolist(), sizes.tolist())]


# --- anchors ----------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts that have the same anchor: row, first start, number, hash.

    The anchor of a window of ``length`` bytes is its leftmost ``gram`` bytes
    of least hash, so equal windows have equal anchors wherever they stand. The
    hash that is returned is mixed once more: least ones are all small.
    """
    span = length - gram + 1
    parts = []
    long = np.flatnonzero(np.diff(offsets) >= length)
    if not len(long):
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    values = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))
    for low in range(0, len(data) - length + 1, CHUNK):
        high = min(low + CHUNK, len(data) - length + 1)  # starts of this chunk
        hashes = mix(window_hashes(values[data[low : high + length - 1]], gram, _BASE))
        n = high - low
        key = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        # least of every `span` consecutive keys: suffix minima of blocks joined with prefix minima
        blocks = -(-len(key) // span) + 1
        padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(key)] = key
        table = padded.reshape(blocks, span)
        ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
        behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        row = np.searchsorted(offsets, np.arange(low, high), "right") - 1
        good = np.arange(low, high) + length <= offsets[row + 1]
        new = np.flatnonzero(good & np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | ~good[:-1]])
        total = np.cumsum(good)
        number = np.diff(np.r_[total[new] - 1, total[-1]]) if len(new) else new
        parts.append((row[new], new + low - offsets[row[new]], number, mix(hashes[place[new]] + np.uint64(1))))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _segment_sizes(length: int, gram: int):
    """Anchor, digest and bytes of the segments of each batch, equal ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", 1 << 20):
                data, offsets = buffers(rows.column("text"))
                row, start, number, hashes = anchors(data, offsets, length, gram)
                raw, begin, size = data.tobytes(), offsets[row] + start, number + length - 1
                digests = [hashlib.blake2b(raw[a : a + n], digest_size=8).digest() for a, n in zip(begin.tolist(), size.tolist())]
                made = np.frombuffer(b"".join(digests), np.int64)
                _, first = np.unique(made, return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[first].view(np.int64)), pa.array(made[first]), pa.array(size[first].astype(np.int64))],
                    ["hash", "digest", "size"],
                )

    return run


def hot_anchors(base: DataFrame, length: int, gram: int, size: int, limit: int) -> np.ndarray:
    """Hashes of anchors with about ``limit`` bytes of distinct segments or more, sorted.

    Counted in a sample of the documents (all up to ``SAMPLE_BYTES``). Only the
    way of a window depends on it, never the result. At most ``MOST_HOT``
    anchors can have that many bytes, because the limit grows with the corpus
    where it must.
    """
    limit = max(limit, size // MOST_HOT)
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_BYTES / max(size, 1)))
    chosen = base.where(F.pmod(F.xxhash64("id", "check"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    found = (
        chosen.mapInArrow(_segment_sizes(length, gram), "hash LONG, digest LONG, size LONG")
        .groupBy("hash", "digest")
        .agg(F.first("size").alias("size"))
        .groupBy("hash")
        .agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        .where((F.col("size") >= limit * share) & (F.col("n") > 1))
        .select("hash")
        .toArrow()
    )
    return np.sort(found.column("hash").to_numpy().astype(np.int64).view(np.uint64))


def _by_window(data: np.ndarray, offsets: np.ndarray, runs: tuple[np.ndarray, ...], length: int, hot: np.ndarray):
    """``runs`` of anchors; each window of a hot one becomes a run of its own, by the hash of its bytes."""
    row, start, number, hashes = runs
    at = np.searchsorted(hot, hashes)
    is_hot = hot[np.minimum(at, len(hot) - 1)] == hashes
    if not is_hot.any():
        return runs
    values = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))
    parts = [tuple(c[~is_hot] for c in runs)]
    where = np.flatnonzero(is_hot)
    for low in range(0, len(where), 2048):
        k = where[low : low + 2048]
        sizes = number[k] + length - 1
        heads = np.cumsum(sizes) - sizes
        inside = np.arange(sizes.sum()) - np.repeat(heads, sizes)
        made = mix(window_hashes(values[data[np.repeat(offsets[row[k]] + start[k], sizes) + inside]], length, _BASE))
        good = np.flatnonzero(inside < np.repeat(number[k], sizes))
        n = number[k]
        parts.append((np.repeat(row[k], n), np.repeat(start[k], n) + inside[good], np.ones(len(good), np.int64), mix(made[good] + np.uint64(1))))
    return tuple(np.concatenate(c) for c in zip(*parts))


# --- packed rows ------------------------------------------------------------------

_KINDS = {"id": np.int64, "check": np.int64, "more": np.int64, "start": np.uint32, "size": np.uint32, "hash": np.uint64, "which": np.uint32}


def _dump(**columns: np.ndarray) -> dict[str, bytes]:
    return {name: planes(values.astype(_KINDS[name])) for name, values in columns.items()}


def _read(row: dict, *names: str) -> list[np.ndarray]:
    out = [from_planes(row[name], _KINDS[name]) for name in names]
    return [x if x.dtype == np.uint64 else x.astype(np.int64) for x in out]


def _range(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The group of a hash: its place among ``parts`` equal ranges."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _cuts(keys: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.r_[np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])
    return list(zip(at.tolist(), np.r_[at[1:], len(keys)].tolist()))


def _schema(*names: str) -> tuple[str, pa.Schema]:
    text = "part INT, " + ", ".join(f"{n} BINARY" for n in names)
    return text, pa.schema([("part", pa.int32())] + [(n, pa.binary()) for n in names])


_DOCUMENT = ["id", "check", "more"]
_PLACES = ("id", "check", "more", "start", "size")
_ANCHORS = ("id", "check", "more", "start", "size", "hash")
_SEGMENTS = ("id", "check", "more", "start", "size", "which", "hash", "contents", "lengths")


def _send(schema: pa.Schema, part: np.ndarray, **columns: np.ndarray) -> list[dict]:
    """Rows by part; missing columns of the schema are empty."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    empty = {n: b"" for n in schema.names if n != "part"}
    return [
        empty | {"part": int(part[a])} | _dump(**{n: c[order[a:b]] for n, c in columns.items()}) for a, b in _cuts(part)
    ]


def _find_anchors(length: int, gram: int, parts: int, block: int, hot: Broadcast):
    """Anchors by hash range; one that repeats in the block is sent once, and all are marked at once.

    Marked ones need no other place and go by document. Windows of ``hot``
    anchors are sent as anchors of their own.
    """
    schema = _schema(*_ANCHORS, "sure")[1]

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, checks, mores, starts, sizes, hashes = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(hashes, kind="stable")
        h = hashes[order]
        new = np.r_[True, h[1:] != h[:-1]]
        twice = ~new
        twice[:-1] |= ~new[1:]
        sure, alone = order[twice], order[new]
        rows = []
        for at, flag, part in (
            (sure, b"1", document_range(ids[sure], checks[sure], parts)), (alone, b"", _range(hashes[alone], parts))
        ):
            if len(at):
                made = _send(
                    schema, part, id=ids[at], check=checks[at], more=mores[at], start=starts[at], size=sizes[at], hash=hashes[at]
                )
                rows += [r | {"sure": flag} for r in made]
        for k in range(0, len(rows), 64):
            yield pa.RecordBatch.from_pylist(rows[k : k + 64], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for rows in slices(batch, "text", 1 << 20):
                data, offsets = buffers(rows.column("text"))
                runs = anchors(data, offsets, length, gram)
                if not len(runs[0]):
                    continue
                row, start, number, hashes = _by_window(data, offsets, runs, length, hot.value) if len(hot.value) else runs
                own = [rows.column(c).to_numpy()[row] for c in ("id", "check", "more")]
                held.append((*own, start, number, hashes))
                size += len(row)
                if size >= block:
                    yield from flush(held)
                    size = 0
        if size:
            yield from flush(held)

    return run


def _shared_anchors(targets: int):
    """Anchors of one hash range that occur at two places, by target group of documents."""
    schema = _schema(*_ANCHORS)[1]

    def run(table: pa.Table) -> pa.Table:
        sure, alone = [], []
        for row in table.to_pylist():
            (sure if row["sure"] else alone).append(_read(row, *_ANCHORS))
        found = [np.concatenate(x) for x in zip(*sure)] if sure else None
        if alone:
            columns = [np.concatenate(x) for x in zip(*alone)]
            order = np.argsort(columns[5], kind="stable")
            h = columns[5][order]
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            same[:-1] |= same[1:].copy()
            mine = [c[order[same]] for c in columns]
            found = mine if found is None else [np.concatenate(x) for x in zip(found, mine)]
        target = document_range(found[0], found[1], targets)
        return pa.Table.from_pylist(_send(schema, target, **dict(zip(_ANCHORS, found))), schema)

    return run


def _per_document(extra: str):
    """Rows (id, check, start and size or hash) of a group of documents, one per document."""
    names = ("id", "check", "more", "start", "size", *([extra] if extra else []))
    schema = pa.schema([(n, pa.int64()) for n in names[:3]] + [(n, pa.binary()) for n in ("start", "size", "hash")])

    def run(table: pa.Table) -> pa.Table:
        columns = [np.concatenate(x) for x in zip(*[_read(row, *names) for row in table.to_pylist()])]
        chosen, doc = numbered(*columns[:3])
        docs = [x[chosen] for x in columns[:3]]
        order = np.lexsort((columns[3], doc))
        doc, columns = doc[order], [c[order] for c in columns[3:]]
        if extra:  # an anchor sent by its block and found again here is one
            starts = columns[0]
            keep = np.r_[np.ones(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | (starts[1:] != starts[:-1])]
            doc, columns = doc[keep], [c[keep] for c in columns]
        ends = np.searchsorted(doc, np.arange(len(chosen) + 1))
        blob = lambda x, w: to_array(x.astype(f"<u{w}").view(np.uint8), ends * w, pa.binary())
        last = blob(columns[2], 8) if extra else pa.array([b""] * len(chosen), pa.binary())
        made = [pa.array(x) for x in docs] + [blob(columns[0], 4), blob(columns[1], 4), last]
        return pa.Table.from_arrays(made, schema=schema)

    return run


def _cut_segments(length: int, parts: int, block: int):
    """Marked segments by hash range, equal ones of a block once.

    A segment that stands twice in a block is repeated from end to end: its
    places are settled at once and go by document, and only its bytes are sent
    by hash range, marked by no place.
    """
    schema = _schema(*_SEGMENTS)[1]

    def flush(known: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        contents = list(known)
        hashes = np.array([known[c][0] for c in contents], np.uint64)
        part = _range(hashes, parts)
        rows, settled = [], []
        for key in np.unique(part).tolist():
            mine = [contents[k] for k in np.flatnonzero(part == key).tolist()]
            single = [(k, *known[c][1]) for k, c in enumerate(mine) if len(known[c]) == 2]
            which, ids, checks, mores, starts = (np.array(x, np.int64) for x in (zip(*single) if single else ((),) * 5))
            rows.append(
                {"part": key, "contents": b"".join(mine), "lengths": np.array([len(c) for c in mine], "<u4").tobytes()}
                | _dump(
                    id=ids, check=checks, more=mores, start=starts, size=np.zeros(len(ids), np.int64), which=which,
                    hash=hashes[part == key],
                )
            )
        for content in contents:
            if len(known[content]) > 2:
                settled += [(*place, len(content)) for place in known[content][1:]]
        if settled:
            columns = [np.array(x, np.int64) for x in zip(*settled)]
            rows += _send(schema, document_range(columns[0], columns[1], parts), **dict(zip(_PLACES, columns)))
        known.clear()
        for k in range(0, len(rows), 16):
            yield pa.RecordBatch.from_pylist(rows[k : k + 16], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            for rows in slices(batch, "text", 1 << 20):
                data, offsets = buffers(rows.column("text"))
                raw = data.tobytes()
                docs = list(zip(*(rows.column(c).to_pylist() for c in ("id", "check", "more"))))
                fields = [rows.column(c).to_pylist() for c in ("start", "size", "hash")]
                for k, doc in enumerate(docs):
                    starts = np.frombuffer(fields[0][k], "<u4").tolist()
                    sizes = np.frombuffer(fields[1][k], "<u4").tolist()
                    hashes = np.frombuffer(fields[2][k], "<u8").tolist()
                    base = int(offsets[k])
                    for s, n, h in zip(starts, sizes, hashes):
                        content = raw[base + s : base + s + n + length - 1]
                        seen = known.get(content)
                        if seen is None:
                            known[content] = [h, (*doc, s)]
                            size += len(content) + 100
                        elif (*doc, s) != seen[1]:
                            seen.append((*doc, s))
                            size += 50
                    if size >= block:
                        yield from flush(known)
                        size = 0
        if known:
            yield from flush(known)

    return run


def _in_arrays(texts: list[bytes], hashes: list[int], length: int, limit: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """``repeated_starts`` by runs of anchors (texts come sorted by them), about ``limit`` bytes an array."""
    first = size = 0
    for k in range(len(texts) + 1):
        if k == len(texts) or (size >= limit and hashes[k] != hashes[k - 1]):
            if k > first:
                yield from zip(texts[first:k], repeated_starts(texts[first:k], length))
            first, size = k, 0
        if k < len(texts):
            size += len(texts[k])


def _search_shard(length: int, targets: int, array_bytes: int):
    """The suffix array of a shard's distinct segments, and the bytes it shows as repeated, by document."""
    schema = _schema(*_PLACES)[1]

    def run(table: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        places: dict[bytes, list] = {}
        for row in table.to_pylist():
            columns = _read(row, *_PLACES)
            if not row["lengths"]:
                out.append(columns)
                continue
            lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
            ends = np.cumsum(lengths)
            mine = [row["contents"][a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]
            of = [None] * len(mine)
            for k, place in zip(_read(row, "which")[0].tolist(), zip(*(c.tolist() for c in columns[:4]))):
                of[k] = place
            for content, place, h in zip(mine, of, _read(row, "hash")[0].tolist()):
                known = places.setdefault(content, [0, [], h])
                if place is None:
                    known[0] += 2  # settled where it came from
                elif place not in known[1]:
                    known[1].append(place)
        texts = sorted(places, key=lambda c: places[c][2])
        found: list[tuple] = []
        for content, hit in _in_arrays(texts, [places[c][2] for c in texts], length, array_bytes):
            many, members, _ = places[content]
            if not members:
                continue
            if many + len(members) > 1:
                runs = [(0, len(content))]
            elif hit.any():
                edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
                runs = [(a, b - a + length - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
            else:
                continue
            found += [(*doc, s + a, n) for *doc, s in members for a, n in runs]
        if found:
            out.append([np.array(x, np.int64) for x in zip(*found)])
        if not out:
            return schema.empty_table()
        columns = [np.concatenate(x) for x in zip(*out)]
        target = document_range(columns[0], columns[1], targets)
        return pa.Table.from_pylist(_send(schema, target, **dict(zip(_PLACES, columns))), schema)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch, "text", 2 << 20):
            data, offsets = buffers(rows.column("text"))
            raw, at = buffers(rows.column("start"))
            starts = np.ascontiguousarray(raw).view("<u4").astype(np.int64) + np.repeat(offsets[:-1], np.diff(at) // 4)
            sizes = np.ascontiguousarray(buffers(rows.column("size"))[0]).view("<u4").astype(np.int64)
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + sizes, -1)
            gone = np.cumsum(change[:-1]) > 0
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True  # spans end with their document
            opens = np.flatnonzero(gone & (edge[:-1] | np.r_[True, ~gone[:-1]]))
            closes = np.flatnonzero(gone & (edge[1:] | np.r_[~gone[1:], True])) + 1
            removed = np.r_[0, np.cumsum(gone)][offsets]
            first = np.searchsorted(opens, offsets)
            own = np.repeat(offsets[:-1], np.diff(first))
            spans = pa.ListArray.from_arrays(
                pa.array(first, pa.int32()),
                pa.StructArray.from_arrays([pa.array(opens - own), pa.array(closes - own)], ["start", "end"]),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("row"), to_array(data[~gone], offsets - removed, pa.binary()), pa.array(np.diff(offsets)),
                    pa.array(np.diff(removed)), spans,
                ],
                ["row", "kept", "n_bytes", "n_removed", "spans"],
            )


def remove_repeated_bytes(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    length: int = 200,
    group_bytes: int = GROUP_BYTES,
    block_anchors: int = BLOCK_ANCHORS,
    block_bytes: int = BLOCK_BYTES,
    array_bytes: int = ARRAY_BYTES,
) -> DataFrame:
    """Cut every byte covered by a string of ``length`` bytes that also starts elsewhere.

    Texts are their UTF-8 bytes; strings do not cross documents, may overlap,
    and are judged on the input. All copies go, the first one too.

    Equal strings have equal anchors (``anchors``), so only segments around
    anchors that occur twice are looked at, and segments of one hash range of
    anchors, a shard, hold all copies of their strings. Every start of a string
    lies in one segment. Each shard holds its distinct segments once, with the
    places they come from, and builds their suffix array by induced sorting (in
    runs of anchors of about ``array_bytes``); permuted common prefixes of ``length`` or more, or a second place of the
    same segment, mark repeated strings. Blocks of rows send an anchor and a
    segment once, so no shard holds more of one than there are blocks. An anchor
    with more than about ``array_bytes`` of distinct segments (``hot_anchors``)
    is replaced by its windows, each under the hash of its own bytes, so no
    shard gathers the surroundings of a frequent line.

    Result: the columns of ``docs`` but the text, and ``kept`` (remaining
    bytes), ``n_bytes``, ``n_removed``, ``spans`` (byte positions of the maximal
    removed runs, end exclusive). Input columns with these names are replaced.
    Null text: no bytes. A null id is an id of its own. Rows that repeat id and
    text are one document and get one result each; rows of one id with
    different texts are different documents.
    """
    require_columns(docs, text, id)
    if length < 16:
        raise ValueError("length must be 16 or more")
    made = ["kept", "n_bytes", "n_removed", "spans"]
    if id in made:
        raise ValueError(f"id cannot be named like the results {made}")
    others = [c for c in docs.columns if c not in (text, *made)]
    size, texts = document_facts(docs, text, id)
    halves = digest_halves(text) if texts > 1 else [F.lit(0).cast("long")] * 2
    base = docs.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("row"),
        F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(_NO_ID)).alias("id"),
        *[half.alias(c) for half, c in zip(halves, ("check", "more"))],
        F.col(f"`{text}`").alias("text"),
    )
    parts = max(1, -(-size // group_bytes))
    gram = max(8, length * 8 // 25)
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(base, length, gram, size, array_bytes))
    one = "id LONG, check LONG, more LONG, start BINARY, size BINARY, hash BINARY"
    marked = (
        base.select("id", "check", "more", "text")
        .mapInArrow(_find_anchors(length, gram, parts, block_anchors, hot), _schema(*_ANCHORS, "sure")[0])
        .groupBy("part")
        .applyInArrow(_shared_anchors(parts), _schema(*_ANCHORS)[0])
        .groupBy("part")
        .applyInArrow(_per_document("hash"), one)
    )
    segments = (
        base.join(marked, _DOCUMENT)
        .select("row", *_DOCUMENT, "text", "start", "size", "hash")  # as below: one exchange for both joins
        .mapInArrow(_cut_segments(length, parts, block_bytes), _schema(*_SEGMENTS)[0])
    )
    found = (
        segments.groupBy("part")
        .applyInArrow(_search_shard(length, parts, array_bytes), _schema(*_PLACES)[0])
        .groupBy("part")
        .applyInArrow(_per_document(""), one)
        .drop("hash")
    )
    joined = base.join(found, _DOCUMENT, "left").select("row", "text", "start", "size")
    kind = joined.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(
        _remove, f"row {kind}, kept BINARY, n_bytes LONG, n_removed LONG, spans ARRAY<STRUCT<start: LONG, end: LONG>>"
    )
    return out.select(*[F.col(f"row.`{c}`") for c in others], *made)
