"""Spelling groups against all pairs compared in Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stridemill.llm import queries, spelling


def _distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _grouped(counts):
    """Each word is compared with every word that shares a string with one letter less, or has it."""
    shelves = {}
    for w in counts:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            shelves.setdefault(v, []).append(w)
    near = {w: set() for w in counts}
    for words in shelves.values():
        for a in words:
            near[a].update(b for b in words if _distance_one(a, b))
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, counts[w], form[w], root, len(near[w]), form[w] and counts[form[w]]))
    return sorted(out)


def _words(rows, rate=97):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % rate == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def _found(frame):
    return sorted(tuple(r) for r in frame.select("word", "n", "form", "root", "n_near", "form_n").collect())


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    expected = _grouped(_words(rows))
    assert sum(r[2] is not None for r in expected) > 20
    assert _found(queries.QUERIES["op12_spelling_groups"](spark, data)) == expected


def test_random_words_of_all_lengths(spark):
    rng = random.Random(3)
    counts = {}
    for n in [*range(1, 8), 12, 19, 20, 21, 22, 64, 65, 400]:
        for _ in range(12):
            w = "".join(rng.choices("abé×z", k=n))
            counts[w] = rng.randint(1, 200)
            for _ in range(3):
                at = rng.randrange(n + 1)
                v = rng.choice([w[:at] + "c" + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + "ÿ" + w[at:]])
                if v:
                    counts[v] = rng.randint(1, 200)
    words = spark.createDataFrame(list(counts.items()), "word STRING, n LONG")
    assert _found(spelling.group_variants(words)) == _grouped(counts)


def test_long_chain_and_ties(spark):
    chain = {"b" * i + "a" * (12 - i): 3 * 2**i for i in range(12)}
    ties = {"vanter": 2, "vantex": 9, "vantes": 9, "vants": 4, "vantess": 18}
    words = spark.createDataFrame(list({**chain, **ties}.items()), "word STRING, n LONG")
    out = _found(spelling.group_variants(words))
    assert out == _grouped({**chain, **ties})
    assert {r[3] for r in out if "b" in r[0] or r[0] == "a" * 12} == {"b" * 11 + "a"}


def test_nulls_repeats_and_no_rows(spark):
    rows = [(None, "Straße STRAßE Éclair éclair eclair eclair"), (None, None), (5, ""), (5, "12 Größe größe größe größe groesse")] * 3
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id LONG, text STRING, word STRING")
    for rate in (97, 2, 1):
        assert _found(spelling.spelling_groups(docs, rate=rate)) == _grouped(_words(rows, rate))
    assert _found(spelling.spelling_groups(docs.limit(0))) == []


def test_a_word_as_long_as_a_text(spark):
    long = "abcdefghij" * 2_000
    docs = spark.createDataFrame([(k, long) for k in range(6)] + [(k, long[:-1]) for k in range(3)], "doc_id LONG, text STRING")
    words = _words([(k, long) for k in range(6)] + [(k, long[:-1]) for k in range(3)])
    assert _found(spelling.spelling_groups(docs)) == _grouped(words)
    assert len(words) == 2


def test_neighbourhood_holds_every_reduced_edit(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(300):
        w = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöüéñ", k=rng.choice([1, 2, 5, 9, 12, 19, 20])))
        at = rng.randrange(len(w) + 1)
        pairs.append((w, rng.choice([w[:at] + "q" + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + "ô" + w[at:]])))
    rows = spark.createDataFrame(pairs, "a STRING, b STRING").where("length(b) > 0").select(
        spelling.reduced("a").alias("a"), spelling.reduced("b").alias("b"), F.length("a").alias("n")
    ).select("b", "n", spelling.neighbourhood("a", "n").alias("near")).collect()
    assert all(r["b"] in r["near"] and len(set(r["near"])) == len(r["near"]) for r in rows)
    # left out, replaced (or as it is) and put in, without counting one twice
    assert all(len(r["near"]) <= r["n"] + 7 * r["n"] + 1 + 7 * (r["n"] + 1) + 1 for r in rows)


def test_ratio_below_two_is_refused(spark):
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([("abcde", 3)], "word STRING, n LONG"), ratio=1)
