"""Token ids in binary files: canonical length-limited Huffman codes, blocks with checkpoints."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stridemill.llm.bpe import STOP, WordBpe, byte_symbols, cut_words, load
from stridemill.llm.text import from_planes, gather, planes, slices, to_array
from stridemill.schema import require_columns
from stridemill.session import fresh_path, stage

MAGIC = b"HUFFIDS1"
#: Longest code, if the ids do not need more: the decoding table has 2**LONGEST rows.
LONGEST = 16
#: Ids after which a block is closed (with its document), and ids from one checkpoint to the next.
BLOCK_IDS = 1 << 18
STEP = 256
#: Ids per file.
FILE_IDS = 12_000_000
CACHE_WORDS = 400_000
#: Words that are looked up together (their number is guessed from the bytes), and characters of a text
#: that are normalised at a time.
RUN_WORDS = 400_000
WORD_BYTES = 5
SEGMENT = 1 << 19
_CUT = re.compile(r"[ \n](?=[0-9A-Za-z])")
_NO_ID = -(2**63)


# --- codes ------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Best code lengths of at most ``longest`` bits for the ids that occur; 0 for the others.

    Package-merge: ``longest`` times, the sorted counts are merged with the
    pairs of the list before. Of the first 2n - 2 entries of the last list, the
    counts add one bit each, and the pairs lead to twice as many first entries
    of the list before.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    if n > 1 << longest:
        raise ValueError(f"{n} ids do not fit codes of {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    current, leaves = weight, [np.ones(n, bool)]
    for _ in range(longest - 1):
        even = len(current) // 2 * 2
        both = np.concatenate([weight, current[:even:2] + current[1:even:2]])
        at = np.argsort(both, kind="stable")
        current = both[at]
        leaves.append(at < n)
    take, bits = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(leaves):
        head = is_leaf[:take]
        single = int(head.sum())
        bits[:single] += 1
        take = 2 * (len(head) - single)
    lengths[order] = bits
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then id, counted up."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    if not len(used):
        return codes
    order = used[np.lexsort((used, lengths[used]))]
    top = int(lengths.max())
    steps = np.uint64(1) << (top - lengths[order].astype(np.int64)).astype(np.uint64)
    at = np.cumsum(steps) - steps  # codes left-aligned to the longest
    codes[order] = (at >> (top - lengths[order].astype(np.int64)).astype(np.uint64)).astype(np.uint32)
    return codes


@lru_cache(maxsize=4)
def _tables(packed: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for every value of the next ``width`` bits."""
    lengths = np.frombuffer(zlib.decompress(packed), np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    repeat = np.int64(1) << (width - lengths[order].astype(np.int64))
    ids, sizes = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.int64)
    total = int(repeat.sum())
    ids[:total] = np.repeat(order, repeat)
    sizes[:total] = np.repeat(lengths[order].astype(np.int64), repeat)
    return ids, sizes


# --- blocks -----------------------------------------------------------------------


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of the ids' codes, and the bit offset of every ``STEP``-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    bits = int(ends[-1]) if len(ids) else 0
    words = np.zeros(bits // 32 + 3, np.uint64)
    if len(ids):
        word = at >> 5
        value = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[first]] |= np.bitwise_or.reduceat(value >> np.uint64(32), first)
        words[word[first] + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[: (bits + 7) // 8], at[::STEP].astype(np.uint64)


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, ids: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """The ids of a block: from all checkpoints at once, one id a step by table."""
    padded = np.frombuffer(payload + bytes(8), np.uint8)
    window = np.ndarray((len(payload) + 1,), ">u4", padded, strides=(1,))
    out = np.zeros((len(checkpoints), STEP), np.uint32)
    at = checkpoints.astype(np.int64)
    mask = (1 << width) - 1
    limit = len(payload) * 8
    for k in range(STEP):
        lanes = slice(0, len(at)) if k < (n - 1) % STEP + 1 else slice(0, len(at) - 1)
        p = np.minimum(at[lanes], limit)
        key = (window[p >> 3].astype(np.int64) >> (32 - width - (p & 7))) & mask
        out[lanes, k] = ids[key]
        at[lanes] += sizes[key]
    return out.reshape(-1)[:n]


_BLOCK = "<IIIQ"  # documents, checkpoints, (reserved), payload bytes
_ENTRY = "<QQQQ"  # offset, size, ids, documents of a block
_HEAD = "<8sII"  # magic, width, bytes of the packed code lengths


def _block(docs: np.ndarray, counts: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    payload, checkpoints = pack(ids, codes, lengths)
    body = [
        struct.pack(_BLOCK, len(docs), len(checkpoints), 0, len(payload)),
        docs.astype("<i8").tobytes(), counts.astype("<u8").tobytes(), checkpoints.astype("<u8").tobytes(), payload,
    ]
    return b"".join(body)


def _read_block(raw: bytes, packed: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, their numbers of ids, and all ids."""
    n, steps, _, size = struct.unpack_from(_BLOCK, raw)
    at = struct.calcsize(_BLOCK)
    docs = np.frombuffer(raw, "<i8", n, at)
    counts = np.frombuffer(raw, "<u8", n, at + 8 * n).astype(np.int64)
    checkpoints = np.frombuffer(raw, "<u8", steps, at + 16 * n)
    payload = raw[at + 16 * n + 8 * steps :][:size]
    total = int(counts.sum())
    if not total:
        return docs, counts, np.zeros(0, np.uint32)
    return docs, counts, unpack(payload, checkpoints, total, *_tables(packed, width), width)


# --- files ------------------------------------------------------------------------


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, as the tasks see it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class _File:
    """A file that appears under its name only when it is whole; a task run again writes the same."""

    def __init__(self, path: str, head: bytes):
        self.system, self.path = _place(path)
        self.system.create_dir(os.path.dirname(self.path), recursive=True)
        self.open_path = f"{os.path.dirname(self.path)}/_{uuid.uuid4().hex}"
        self.out = self.system.open_output_stream(self.open_path)
        self.out.write(head)
        self.at, self.entries = len(head), []

    def add(self, raw: bytes, ids: int, docs: int) -> None:
        self.out.write(raw)
        self.entries.append((self.at, len(raw), ids, docs))
        self.at += len(raw)

    def close(self) -> None:
        self.out.write(b"".join(struct.pack(_ENTRY, *e) for e in self.entries) + struct.pack("<Q8s", len(self.entries), MAGIC))
        self.out.close()
        self.system.move(self.open_path, self.path)


def read_footer(path: str) -> list[tuple[int, int, int, int]]:
    """Offset, size, ids and documents of the blocks of a file."""
    system, place = _place(path)
    with system.open_input_file(place) as f:
        size = f.size()
        f.seek(size - 16)
        n, magic = struct.unpack("<Q8s", f.read(16))
        if magic != MAGIC:
            raise ValueError(f"{path} is no whole file of ids")
        f.seek(size - 16 - n * struct.calcsize(_ENTRY))
        raw = f.read(n * struct.calcsize(_ENTRY))
    return [struct.unpack_from(_ENTRY, raw, k * struct.calcsize(_ENTRY)) for k in range(n)]


# --- the tokenizer ----------------------------------------------------------------


class _Numbers(dict):
    """Numbers of words; one met first gets the next number and is noted in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class _Words:
    """Ids of words by the tokenizers library, asked once for each word; bounded.

    The words of many texts are cut together as spans of bytes. The different
    ones of a run become numbers; the ids of all known words lie in one array,
    each word's at its number's place, and gathers give the ids of the whole run.

    A new word goes to the library's model as it stands, spelled in its byte
    symbols: the library would cut and normalise it no further.
    """

    def __init__(self, content: str, end: int | None):
        self.split = WordBpe(json.loads(content), matcher=False)
        library = Tokenizer.from_str(content)
        self.model = library.model
        self.symbols = np.array([ord(s) for s in byte_symbols()], "<u2")
        self.symbols[ord(" ")] = ord(" ")  # in no word
        self.top = max([*library.get_vocab(with_added_tokens=True).values(), end or 0]) + 1
        self.end = end
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        special, end = self.split.special, [] if self.end is None else [self.end]
        self._numbers([*special, ""])  # no word is empty: it stands for the end mark
        self.add(np.array([*special.values(), *end], np.uint32), np.array([1] * len(special) + [len(end)]))

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of the words that are noted as new."""
        known = len(self.number) - len(self.number.new)
        need = self.used + len(ids)
        while need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.number) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : need] = ids
        self.size[known : known + len(sizes)] = sizes
        self.start[known : known + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used = need
        self.number.new = []

    def learn(self, words: list[str]) -> None:
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        ids, sizes = [], []
        for word in self.symbols[raw].tobytes().decode("utf-16-le").split(" "):
            tokens = self.model.tokenize(word)
            ids += [t.id for t in tokens]
            sizes.append(len(tokens))
        if len(sizes) != len(words):
            raise ValueError("words and tokens do not fit together")
        self.add(np.array(ids, np.uint32), np.array(sizes))

    def _numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def _coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        try:
            number = self._numbers(words)
            if self.number.new and len(self.number) > CACHE_WORDS:
                self.clear()
                number = self._numbers(words)
            if self.number.new:
                self.learn(self.number.new)
        except BaseException:
            self.clear()  # no word may keep a number without ids
            raise
        size = self.size[number]
        return gather(self.flat, self.start[number], size), size.astype(np.int32)

    def _run(self, joined: bytes, special: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words of joined texts, how many each word has, and the places of the ends among the words."""
        data, lengths = cut_words(joined, special)
        words = to_array(data, np.r_[0, np.cumsum(lengths)], pa.string()).dictionary_encode()
        ids, sizes = self._coded(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        at, starts = words.indices.to_numpy(), np.cumsum(sizes, dtype=np.int64) - sizes
        return gather(ids, starts[at], sizes[at]), sizes[at], np.flatnonzero(lengths == 0)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after the other with their end marks, and how many each has.

        Words are looked up in runs, so that a very long text takes little more
        memory than its ids.
        """
        run, special, held = [], [], 0
        runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            nonlocal held
            runs.append(self._run(b"".join(run), special))
            run.clear()
            special.clear()
            held = 0

        for text in texts:
            for piece, marked in self.split.pieces(text):
                for segment in [piece] if marked else _segments(piece):
                    raw = (segment if marked else self.split.normalised(segment)).encode()
                    if marked:
                        special.append((held, held + len(raw)))
                    run += [raw, b" "]  # no word reaches over the end of a segment
                    held += len(raw) + 1
                    if held >= RUN_WORDS * WORD_BYTES:
                        flush()
            run.append(STOP)
            held += 1
        flush()
        ids, sizes, ends = zip(*runs)
        words = np.cumsum([0, *map(len, sizes)])
        before = np.r_[0, np.cumsum(np.concatenate(sizes), dtype=np.int64)]
        stops = np.concatenate([e + w for e, w in zip(ends, words)])
        return np.concatenate(ids), np.diff(before[stops + 1], prepend=0)


def _segments(text: str) -> Iterator[str]:
    """A text in pieces of about ``SEGMENT`` characters, cut at white space before a plain letter or digit:
    neither words nor their normalisation reach across it."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = _CUT.search(text, at + SEGMENT)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


@lru_cache(maxsize=1)
def _words(content: str, end: int | None) -> _Words:
    return _Words(content, end)


def _kind(top: int) -> str:
    """The smallest kind of integer that holds ids below ``top``."""
    return "<u2" if top <= 1 << 16 else "<u4"


def _squeeze(ids: np.ndarray) -> bytes:
    """Ids for a table between two steps: byte planes, compressed."""
    return pa.compress(planes(ids), "zstd", asbytes=True) if len(ids) else b""


def _unsqueeze(raw: bytes, n: int, kind: str) -> np.ndarray:
    return from_planes(pa.decompress(raw, np.dtype(kind).itemsize * n, "zstd", asbytes=True), kind) if n else np.zeros(0, kind)


# --- jobs -------------------------------------------------------------------------


_CODED = "id LONG, tie LONG, row LONG, n LONG, ids BINARY, tokens ARRAY<INT>, times ARRAY<LONG>"


def encode(docs: DataFrame, tokenizer: str, text: str = "text", id: str = "doc_id", end: int | None = 1) -> tuple[DataFrame, str]:
    """``id``, ``tie`` (a hash of the text), ``row`` (a number of its own), ``n`` and the
    compressed ids of every document, written once, and the kind of integer they have.

    Each task adds one row without ``n``: its ``tokens`` and how often it met them.
    """
    content = docs.sparkSession.sparkContext.broadcast(load(tokenizer))
    kind = _kind(_words(content.value, end).top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(content.value, end)
        seen, row = np.zeros(words.top, np.int64), TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows in slices(batch, "text", 2 << 20):
                ids, counts = words.ids([t or "" for t in rows.column("text").to_pylist()])
                seen += np.bincount(ids, minlength=words.top)
                ids, at = ids.astype(kind), np.r_[0, np.cumsum(counts)].tolist()
                made = [_squeeze(ids[i:j]) for i, j in zip(at, at[1:])]
                n = len(made)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("id"), rows.column("tie"), pa.array(np.arange(row, row + n)), pa.array(counts),
                        pa.array(made, pa.binary()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64())),
                    ],
                    ["id", "tie", "row", "n", "ids", "tokens", "times"],
                )
                row += n
        some = np.flatnonzero(seen)
        none = [pa.nulls(1, pa.int64())] * 4
        yield pa.RecordBatch.from_arrays(
            [
                *none, pa.nulls(1, pa.binary()), pa.array([some.tolist()], pa.list_(pa.int32())),
                pa.array([seen[some].tolist()], pa.list_(pa.int64())),
            ],
            ["id", "tie", "row", "n", "ids", "tokens", "times"],
        )

    rows = docs.select(
        F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(_NO_ID)).alias("id"),
        F.xxhash64(F.col(f"`{text}`").cast("binary")).alias("tie"), F.col(f"`{text}`").alias("text"),
    )
    return stage(rows.mapInArrow(run, _CODED), "coded"), kind


def id_counts(coded: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents; one row per id goes to the driver."""
    each = coded.where(F.col("tokens").isNotNull()).select(F.explode(F.arrays_zip("tokens", "times")).alias("e"))
    found = each.groupBy(F.col("e.tokens").alias("token")).agg(F.sum("e.times").alias("n")).toArrow()
    tokens = found.column("token").to_numpy()
    counts = np.zeros(int(tokens.max()) + 1 if len(tokens) else 1, np.int64)
    counts[tokens] = found.column("n").to_numpy()
    return counts


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    text: str = "text",
    id: str = "doc_id",
    end: int | None = 1,
    file_ids: int = FILE_IDS,
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Write the ids of all documents in ascending order of ``id`` to files below ``path``.

    Ids come from the tokenizers library (no special tokens added), ``end`` is
    put behind each document. They are written once, unordered, and counted as
    they are made; the code lengths are the best of at most 16 bits (more if the number of ids
    asks for it) and stand in every file. Documents are dealt by range of id,
    about ``file_ids`` ids each, and sorted; a task writes one file in blocks
    of whole documents, about ``block_ids`` ids each. A block has a checkpoint
    (bit offset) every 256 ids and can be decoded alone; the file ends with the
    places of its blocks. Rows of one id are ordered by a hash of their text;
    equal rows may lie in several files; a null id comes first; null text has
    no ids but the end.

    Returns the index, one row per block: ``shard``, ``path``, ``offset``,
    ``size``, ``n_ids``, ``n_docs``, ``before`` (ids of the shard before it).
    """
    require_columns(docs, text, id)
    spark = docs.sparkSession
    coded, kind = encode(docs, tokenizer, text, id, end)
    counts = id_counts(coded)
    width = max(LONGEST, int(np.count_nonzero(counts)).bit_length() + 1)
    packed = zlib.compress(code_lengths(counts, width).tobytes())
    shared = spark.sparkContext.broadcast((packed, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, width = shared.value
        lengths = np.frombuffer(zlib.decompress(packed), np.uint8)
        codes = canonical(lengths)
        shard = TaskContext.get().partitionId()
        name = f"{path}/part-{shard:06d}.ids"
        out, held_docs, held, size, before, index = None, [], [], 0, 0, []

        def flush():
            nonlocal size, before
            ids = np.concatenate(held)
            raw = _block(np.array(held_docs, np.int64), np.array([len(h) for h in held], np.int64), ids, codes, lengths)
            index.append((shard, name, out.at, len(raw), len(ids), len(held), before))
            out.add(raw, len(ids), len(held))
            before += len(ids)
            held_docs.clear()
            held.clear()
            size = 0

        for batch in batches:
            out = out or _File(name, struct.pack(_HEAD, MAGIC, width, len(packed)) + packed)
            for doc, n, ids in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "ids"))):
                held_docs.append(doc)
                held.append(_unsqueeze(ids, n, kind))
                size += n
                if size >= block_ids:
                    flush()
        if out:
            if held:
                flush()
            out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(zip(*index) if index else [()] * 7, _INDEX.types)], schema=_INDEX
        )

    system, place = _place(path)
    system.create_dir(place, recursive=True)  # also for no documents
    files = max(1, -(-int(counts.sum()) // file_ids))
    rows = coded.where(F.col("n").isNotNull()).select("id", "tie", "row", "n", "ids")
    dealt = rows.repartitionByRange(files, "id", "tie", "row").sortWithinPartitions("id", "tie", "row")
    return stage(
        dealt.mapInArrow(run, "shard INT, path STRING, offset LONG, size LONG, n_ids LONG, n_docs LONG, before LONG"), "index"
    )


_INDEX = pa.schema(
    [("shard", pa.int32()), ("path", pa.string())] + [(c, pa.int64()) for c in ("offset", "size", "n_ids", "n_docs", "before")]
)


def list_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The index of ``write_ids`` from the footers of the files below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column("path").to_pylist():
                shard, before = int(re.search(r"part-(\d+)\.ids$", name)[1]), 0
                for offset, size, ids, docs in read_footer(name):
                    rows.append((shard, name, offset, size, ids, docs, before))
                    before += ids
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 7, _INDEX.types)], schema=_INDEX
            )

    return files.mapInArrow(run, "shard INT, path STRING, offset LONG, size LONG, n_ids LONG, n_docs LONG, before LONG")


def read_ids(blocks: DataFrame, id: str = "doc_id") -> DataFrame:
    """``id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids``
    (little-endian unsigned 32-bit) of every document, from the blocks of the files.

    Blocks are dealt evenly and decoded alone. Only one row per file (its
    number of ids) goes to the driver, for the start of each file.
    """
    spark = blocks.sparkSession
    blocks = stage(blocks, "blocks")
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").toArrow()
    shards, sums = totals.column("shard").to_numpy(), totals.column("n").to_numpy()
    shared = spark.sparkContext.broadcast((shards, np.cumsum(sums) - sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, bases = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                system, place = _place(row["path"])
                with system.open_input_file(place) as f:
                    magic, width, size = struct.unpack(_HEAD, f.read(struct.calcsize(_HEAD)))
                    if magic != MAGIC:
                        raise ValueError(f"{row['path']} is no file of ids")
                    packed = f.read(size)
                    f.seek(row["offset"])
                    raw = f.read(row["size"])
                docs, counts, ids = _read_block(raw, packed, width)
                base = bases[np.searchsorted(shards, row["shard"])] + row["before"]
                places = np.r_[0, np.cumsum(counts)]
                for k in range(0, len(docs), 2000):
                    part = places[k : k + 2001]
                    data = ids[part[0] : part[-1]].astype("<u4").view(np.uint8)
                    own = docs[k : k + 2000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, mask=own == _NO_ID), pa.array(base + part[:-1]), pa.array(np.diff(part)),
                            to_array(data, (part - part[0]) * 4, pa.binary()),
                        ],
                        ["id", "start", "n_tokens", "ids"],
                    )

    dealt = blocks.select("shard", "path", "offset", "size", "before").repartition(
        max(1, min(len(shards), 1 << 16)), "shard", "offset"
    )
    return dealt.mapInArrow(run, "id LONG, start LONG, n_tokens LONG, ids BINARY").withColumnRenamed("id", id)


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", id: str = "doc_id", **limits) -> DataFrame:
    """Write the ids to a folder of their own and read the files back."""
    path = fresh_path(docs.sparkSession, "ids")
    write_ids(docs, path, tokenizer, text, id, **limits)
    return read_ids(list_blocks(docs.sparkSession, path), id)
