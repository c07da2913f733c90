from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from stridemill.llm import huffman, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def plain_huffman_cost(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    return cost


@pytest.mark.parametrize("n", [2, 3, 10, 500])
def test_lengths_are_huffman_lengths(n):
    rng = np.random.default_rng(n)
    counts = rng.integers(1, 1000, n)
    lengths = huffman.code_lengths(counts, 30)
    assert (counts * lengths).sum() == plain_huffman_cost(counts)
    assert sum(2.0 ** -lengths.astype(float)) == 1


def test_limited_lengths_are_best():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    from itertools import product

    for limit in (3, 4, 5, 7):
        lengths = huffman.code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0 ** -lengths.astype(float)) <= 1
        best = min(
            sum(c * l for c, l in zip(counts, ls))
            for ls in product(range(1, limit + 1), repeat=8)
            if list(ls) == sorted(ls, reverse=True) and sum(2.0**-l for l in ls) <= 1
        )
        assert (counts * lengths).sum() == best
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def test_canonical_codes_are_prefix_free():
    lengths = huffman.code_lengths(np.r_[0, np.random.default_rng(1).integers(0, 50, 300)], 12)
    codes = huffman.canonical(lengths)
    bits = sorted(format(c, f"0{l}b") for c, l in zip(codes, lengths) if l)
    assert all(not b.startswith(a) for a, b in zip(bits, bits[1:]))


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 5000])
def test_blocks(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 3000).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=3001), 16)
    codes = huffman.canonical(lengths)
    docs, counts = np.array([4, 9, 9]), np.array([0, n // 2, n - n // 2])
    raw = huffman._block(docs, counts, ids, codes, lengths)
    a, b, c = huffman._read_block(raw, zlib.compress(lengths.tobytes()), 16)
    assert (a == docs).all() and (b == counts).all() and (c == ids).all()


ROWS = [
    (5, "Hello world"), (1, None), (2, ""), (9, "word " * 3000), (9, "again"), (5, "Hello world"), (None, "nobody"), (7, "é" * 900), (3, "<|endoftext|> x"),
]


@pytest.mark.parametrize("limits", [{}, {"file_ids": 60, "block_ids": 20}])
def test_files(spark, limits):
    frame = spark.createDataFrame([(*r, 1, "p") for r in ROWS], "doc_id LONG, text STRING, start INT, path STRING")
    got = huffman.round_trip(frame, PATH, **limits).collect()
    tie = lambda t: 42 if t is None else xxhash.xxh64(t.encode(), seed=42).intdigest()
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, signed(tie(r[1]))))
    want, start = [], 0
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == [(i, s, n, bytearray(b)) for i, s, n, b in want]


def test_words_are_looked_up_in_runs(monkeypatch):
    """Small runs, segments and a small table give the ids of whole texts."""
    texts = ["", "one two three " * 400, "<|endoftext|>don't  stop\n\nnow <unk> " * 50, "é" * 300 + " ΑΣ ς İx ﬁ " * 40, "x" * 5000, "a\u0301 e\u0301 " * 90]
    for run, segment, cache in ((100_000, 1 << 19, 400_000), (7, 30, 60), (1, 1, 2000)):
        monkeypatch.setattr(huffman, "RUN_WORDS", run)
        monkeypatch.setattr(huffman, "SEGMENT", segment)
        monkeypatch.setattr(huffman, "CACHE_WORDS", cache)
        for end in (1, None):
            words = huffman._Words(huffman.load(PATH), end)
            for _ in range(2):
                ids, counts = words.ids(texts)
                want = [LIBRARY.encode(t, add_special_tokens=False).ids + ([end] if end else []) for t in texts]
                assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_words_are_looked_up_once(monkeypatch):
    seen = []

    class Word(str):
        def __hash__(self):
            seen.append(self)
            return str.__hash__(self)

    words = huffman._Words(huffman.load(PATH), 1)
    want = words._coded(["one", "unheard", "one"])
    seen.clear()
    got = words._coded([Word("one"), Word("unheard"), Word("one")])
    assert seen == ["one", "unheard", "one"] and all((a == b).all() for a, b in zip(got, want))
    # a run that failed leaves no word without ids
    with monkeypatch.context() as m:
        m.setattr(words, "learn", lambda new: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            words._coded(["never", "met"])
    assert words.ids(["never met"])[0].tolist() == [*LIBRARY.encode("never met", add_special_tokens=False).ids, 1]


def test_only_different_words_are_looked_up(monkeypatch):
    """A run hands each of its different words to Python once, however often it occurs."""
    words, seen = huffman._Words(huffman.load(PATH), 1), []
    coded = words._coded
    monkeypatch.setattr(words, "_coded", lambda some: seen.append(list(some)) or coded(some))
    texts = ["One two, été. <|endoftext|>" * 300, "two two", "", "it's " * 40]
    ids, counts = words.ids(texts)
    want = [[*LIBRARY.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(seen) == 1 and sorted(seen[0]) == sorted({"one", "two", ",", "été", ".", "<|endoftext|>", "", "it", "'s"})


def test_new_words_are_those_of_the_library():
    """Any bytes inside a word: control characters, two to four bytes, long runs."""
    texts = ["\x00\x01a\x7f", "naïve ÿ \xadx", "日本語 ελλάς", "𝒳𝒴 😀😀😀", "ab" * 700, "!" * 300, "'s 'll ''ve '", "x's'tis 're9've", "\x85 \xa0\u3000 \x1c", "½²٣", "\u0378ꟋꟍA"]
    for end in (1, None):
        ids, counts = huffman._Words(huffman.load(PATH), end).ids(texts)
        want = [LIBRARY.encode(t, add_special_tokens=False).ids + ([end] if end else []) for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert [len(x) for x in huffman._Words(huffman.load(PATH), 1).ids([])] == [0, 0]


def test_repeated_rows_are_dealt_to_several_files(spark, tmp_path):
    frame = spark.createDataFrame([(5, "same words again")] * 400 + [(6, "x")], "doc_id LONG, text STRING")
    index = huffman.write_ids(frame, str(tmp_path / "ids"), PATH, file_ids=200, block_ids=50).collect()
    assert len({r.path for r in index}) > 3
    got = huffman.read_ids(huffman.list_blocks(spark, str(tmp_path / "ids"))).orderBy("start").collect()
    assert [r.start for r in got] == [sum(g.n_tokens for g in got[:k]) for k in range(len(got))]
    assert [r.doc_id for r in got] == [5] * 400 + [6]


def test_empty(spark):
    assert huffman.round_trip(spark.createDataFrame([], "doc_id LONG, text STRING"), PATH).count() == 0


def test_unfinished_file_is_refused(spark, tmp_path):
    frame = spark.createDataFrame(ROWS, "doc_id LONG, text STRING")
    index = huffman.write_ids(frame, str(tmp_path / "ids"), PATH).collect()
    assert huffman.read_footer(index[0].path)
    raw = open(index[0].path, "rb").read()
    (tmp_path / "part-000000.ids").write_bytes(raw[:-3])
    with pytest.raises(ValueError):
        huffman.read_footer(str(tmp_path / "part-000000.ids"))


def test_query(spark, data):
    rows = sorted(map(tuple, spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()))
    want, start = {}, 0
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + [1]
        want[i] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op10_token_files"](spark, data).collect()}
    assert got == want
