from __future__ import annotations

import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stridemill.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    model, cache, offsets = bpe._loaded(bpe.load(PATH))
    return lambda text: list(np.frombuffer(bpe.encode_text(model, cache, text), "<u4"))


LIBRARY, OWN = Tokenizer.from_file(PATH), bpe._loaded(bpe.load(PATH))


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(bpe.encode_text(OWN[0], OWN[1], text), "<u4").tolist()
    assert got == want, text
    data, _ = OWN[2].decode(np.array(want, np.int64), np.array([len(want)]))
    assert bytes(data).decode() == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("a e th in er ing s t n o r aa ha lol !! ! . ' 's 'll é É ñ ß 1 2 ½ ² ª <|endoftext|> <|start \n Σ İ ﬁ 漢 字 é".split(" ")), max_size=30).map("".join))
def test_likely_pieces(text):
    same(text)


def test_every_character():
    for first in range(0, 0x3000, 64):
        same(" ".join(f"a{chr(c)}b {chr(c)} A{chr(c)}{chr(c)}" for c in range(first, first + 64)))
    for first in (0x3000, 0xAC00, 0xFB00, 0xFE00, 0xFF00, 0x1F300, 0x1D400, 0x10400):
        same(" ".join(f"a{chr(c)}b {chr(c)}" for c in range(first, first + 256)))


def cut(texts):
    data, lengths = bpe.cut_words(b"".join(OWN[0].normalised(t).encode() + bpe.STOP for t in texts))
    ends = np.cumsum(lengths).tolist()
    return [bytes(data[a:b]).decode() for a, b in zip([0, *ends], ends)]


def one_by_one(texts):
    return [w for t in texts for w in [*OWN[0].words(t), ""]]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(max_size=30) | st.lists(st.sampled_from("a S 's 'LL 're ' ! 1 ½ é \n \x85 Σ İ 漢 ٣ 😀".split(" ")), max_size=20).map("".join), max_size=6))
def test_texts_cut_together(texts):
    assert cut(texts) == one_by_one(texts)


def test_every_character_cut_together():
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b {c}{c}1{c}" for c in chars[k : k + 4096]) for k in range(0, 0x33480, 4096)]
    texts += ["".join(chars[k : k + 4096]) for k in range(0x33000, len(chars), 4096)]
    assert cut(texts) == one_by_one(texts)


def test_vocabulary_strings():
    tokens = [t.replace("</w>", "") for t in list(OWN[0].vocab)[256::7]]
    text = " ".join(t for t in tokens if t.isascii())
    same(text)
    same("".join(t for t in tokens if t.isascii() and t.isalpha())[:20_000])


def test_long_words():
    for unit in ("a", "th", "ing", "lololo", "é", "!", "-=", "xyz"):
        same(unit * 3000)


def test_operator_edges(spark):
    rows = [(1, None, 5, "z"), (2, "", 6, "z"), (3, "Hello  world!", 7, "z"), (3, "Hello  world!", 7, "z"), (None, "<|endoftext|> é", 8, "z")]
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING, n_tokens INT, row STRING")
    coded = bpe.encode(frame, PATH)
    assert coded.columns == ["doc_id", "row", "ids", "n_tokens"]
    back = bpe.decode(coded, PATH).collect()
    assert len(back) == 5
    for r in back:
        text = next(t for i, t, *_ in rows if i == r.doc_id) or ""
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{r.n_tokens}I", r.ids)) == want and r.text == LIBRARY.decode(want, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(frame.limit(0), PATH), PATH).count() == 0


def test_query(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op2_bpe"](spark, data).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        said = LIBRARY.decode(ids, skip_special_tokens=False)
        sha = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i] == (len(ids), sha, hashlib.sha256(said.encode()).hexdigest())
