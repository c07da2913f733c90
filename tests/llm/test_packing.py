from __future__ import annotations

import collections
import re

import numpy as np
import pytest

from stridemill.llm import packing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_best_fit(lengths, sizes, price):
    """The rule read literally: every open bin is looked at."""
    sizes = sorted(sizes)
    pieces = []
    for i, n in enumerate(lengths):
        for k in range(max(1, -(-n // sizes[-1]))):
            pieces.append((min(n - k * sizes[-1], sizes[-1]), i, k))
    total = collections.Counter(p[0] for p in pieces)
    pieces.sort(key=lambda p: -p[0])
    bins = []
    for at, (need, i, k) in enumerate(pieces):
        open_ = [b for b in bins if b["size"] - b["used"] >= max(need, 1)]  # a full sequence takes nothing more
        if open_:
            tight = min(b["size"] - b["used"] for b in open_)
            b = max((b for b in open_ if b["size"] - b["used"] == tight), key=lambda b: b["touched"])
        else:
            left = sum(p[0] for p in pieces[at + 1 :])

            def cost(c):
                more = min(c - need, left, sum(n * m for n, m in total.items() if n <= c - need))
                return price[c] / max(need + more, 1)

            b = {"size": min((c for c in sizes if c >= need), key=lambda c: (cost(c), c)), "used": 0, "items": []}
            bins.append(b)
        b["used"] += need
        b["touched"] = at
        b["items"].append((i, k, need))
    for b in bins:
        b["size"] = min((c for c in sizes if c >= b["used"]), key=lambda c: (price[c], c))
    return sorted((b["size"], tuple(sorted(b["items"]))) for b in bins)


@pytest.mark.parametrize("price", [None, {8: 9.0, 16: 17.0, 50: 60.0}])
def test_against_the_literal_rule(price):
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 200):
        lengths = rng.integers(0, 130, n)
        got = packing.best_fit(lengths, [8, 16, 50], price)
        bins = collections.defaultdict(list)
        for i, k, b, c, m in zip(got["item"], got["piece"], got["bin"], got["capacity"], got["length"]):
            bins[b, c].append((int(i), int(k), int(m)))
        mine = sorted((int(c), tuple(sorted(v))) for (b, c), v in bins.items())
        assert mine == slow_best_fit([int(x) for x in lengths], [8, 16, 50], price or {8: 8.0, 16: 16.0, 50: 50.0})


def whole(rows, texts, capacities):
    """Every sequence is filled without gaps, every document is there once and in order."""
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.place)
        assert [r.place for r in pieces if r.length] == list(np.cumsum([0] + [r.length for r in pieces if r.length])[:-1])
        used = sum(r.length for r in pieces)
        assert {r.used for r in pieces} == {used} and {r.capacity for r in pieces} == {min(c for c in capacities if c >= used)}
    for doc, pieces in by_doc.items():
        words = WORD.findall(texts[doc] or "")
        pieces.sort(key=lambda r: r.piece)
        assert [w for r in pieces for w in WORD.findall(r.text)] == words
        assert sum(r.length for r in pieces) == len(words) + 1
    assert set(by_doc) == set(texts)


def test_texts(spark):
    texts = {1: None, 2: "", 3: " a b  c\n", 4: " ".join(f"w{k}" for k in range(3000)), 5: "é ñ " * 40, None: "x"}
    frame = spark.createDataFrame([(k, t, 5, "s") for k, t in texts.items()], "doc_id LONG, text STRING, used INT, piece STRING")
    for limits in ({}, {"block_rows": 2}, {"block_bytes": 20}):
        rows = packing.pack_documents(frame, capacities=(4, 16, 64), **limits).collect()
        whole(rows, texts, (4, 16, 64))


def test_repeated_rows_lengths_and_empty(spark):
    frame = spark.createDataFrame([(1, 5), (1, 5), (2, None), (3, -4), (4, 100)], "doc_id LONG, length LONG")
    rows = packing.pack_lengths(frame, capacities=(10, 30)).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == [(1, 5), (1, 5), (2, 0), (3, 0), (4, 10), (4, 30), (4, 30), (4, 30)]
    empty = spark.createDataFrame([], "doc_id LONG, text STRING")
    assert packing.pack_documents(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(empty, capacities=(0, 4))


def test_query(spark, data):
    texts = dict(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.QUERIES["op8_best_fit_packing"](spark, data).collect()
    whole(rows, texts, packing.CAPACITIES)
    room = {r.sequence_id: (r.capacity, r.used) for r in rows}
    assert sum(u for _, u in room.values()) / sum(c for c, _ in room.values()) > 0.97
