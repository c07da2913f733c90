"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.llm.text import buffers, slices, to_array
from stridemill.schema import require_columns

#: Stands for the end of a word in matched strings; no symbol of the vocabulary.
_END = "\x00"
#: Words whose ids a task remembers before it starts anew.
CACHE_WORDS = 400_000

_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Letters and digits below 0x100 spelled out; all other texts go by Unicode property.
_PLAIN = (
    r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xffA-Z\xc0-\xd6\xd8-\xde]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    + r"|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xffA-Z\xc0-\xd6\xd8-\xde0-9\xb2\xb3\xb9\xbc-\xbe]+"
)
_LATIN, _PLAIN = re.compile(f"{_CONTRACTIONS}|{_PLAIN}"), re.compile(_PLAIN)
#: Letters and digits that Unicode 16 added to 15.1 (the properties in use are those of 16).
_ADDED = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x113B7), (0x113D1, 0x113D3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79),
    (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
#: Capitals that Unicode 16 added, with their small letters.
_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B} | {
    c: c + 0x20 for c in range(0x10D50, 0x10D66)
}
_CAPITAL = re.compile("[" + "".join(map(chr, _SMALL)) + "]")
#: Stands for characters assigned later or never: no letter, number or space.
_OTHER = "\ue000"
_WIDE = re.compile(r"[^\x00-\xff]")
_UNICODE = regex.compile(_CONTRACTIONS + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: Ends a text where normalised texts are joined as bytes; UTF-8 has no such byte.
STOP = b"\xff"
#: Kinds of characters: white space, letters and signs (words are runs), numbers (each a word), stops.
_SPACE, _LETTER, _NUMBER, _SIGN, _STOP = range(5)
_KINDS = (regex.compile(r"\p{White_Space}"), regex.compile(r"\p{L}"), regex.compile(r"\p{N}"))
_UNKNOWN = 255


def _unassigned(c: str) -> bool:
    return unicodedata.category(c) == "Cn" and not any(a <= ord(c) <= b for a, b in _ADDED)


def _kind(c: str) -> int:
    """The kind of a character."""
    if c > "\xff" and _unassigned(c):
        return _SIGN
    return next((kind for kind, has in enumerate(_KINDS) if has.match(c)), _SIGN)


#: The kinds of all characters, worked out when first met, and those of single bytes.
_kinds = np.full(0x110000, _UNKNOWN, np.uint8)
_BYTES = bytes([*(_kind(chr(c)) for c in range(128)), *[_SIGN] * 127, _STOP])


def _wide_kinds(raw: np.ndarray, lead: np.ndarray, kinds: np.ndarray) -> None:
    """Write the kinds of characters of several bytes, which start at ``lead``, at all their bytes."""
    head = raw[lead].astype(np.int64)
    size = 2 + (head >= 0xE0) + (head >= 0xF0)
    value, at = head & (0x7F >> size), {k: lead[size > k] + k for k in (1, 2, 3)}
    for k in at:
        value[size > k] = value[size > k] << 6 | raw[at[k]] & 0x3F
    kind = _kinds[value]
    if (kind == _UNKNOWN).any():
        for c in np.unique(value[kind == _UNKNOWN]).tolist():
            _kinds[c] = _kind(chr(c))
        kind = _kinds[value]
    kinds[lead] = kind
    for k in at:
        kinds[at[k]] = kind[size > k]


def cut_words(joined: bytes, special: Sequence[tuple[int, int]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """The words of normalised texts, each ended by ``STOP``: their bytes, one after the other,
    and the number of bytes of each; a stop is a word of no bytes.

    Cuts many texts together as ``WordBpe.words`` cuts one. ``special``: the
    spans of bytes that are words as they stand.
    """
    raw = np.frombuffer(joined, np.uint8)
    n = len(raw)
    kinds = np.frombuffer(bytearray(joined.translate(_BYTES)), np.uint8)
    lead = np.flatnonzero((raw >= 0xC0) & (raw < 0xF8))
    _wide_kinds(raw, lead, kinds)
    first = np.ones(n + 1, bool)
    first[1:n] = kinds[1:] != kinds[:-1]
    first[:n] |= (kinds == _NUMBER) | (kinds == _STOP)
    if len(lead):
        first[:n] &= (raw & 0xC0) != 0x80  # no word starts inside a character
    _contract(raw, first)
    for a, b in special:
        first[a + 1 : b] = False
        first[[a, b]] = True
        kinds[a:b] = _SIGN
    starts = np.flatnonzero(first)
    kind, lengths = kinds[starts[:-1]], np.diff(starts)
    lengths[kind == _STOP] = 0
    return raw[(kinds != _SPACE) & (kinds != _STOP)], lengths[kind != _SPACE]


def _contract(raw: np.ndarray, first: np.ndarray) -> None:
    """Move the starts of words behind the contractions: an apostrophe that starts a word, and its letters."""
    padded = np.concatenate([raw, np.zeros(2, np.uint8)])
    at = np.flatnonzero(raw == ord("'"))
    at = at[first[at]]
    a, b = padded[at + 1], padded[at + 2]
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    two = np.zeros(len(at), bool)
    for x, y in (b"re", b"ve", b"ll"):
        two |= (a == x) & (b == y)
    at, length = at[one | two], 2 + two[one | two]
    first[at + 1] = False
    first[at + length] = True


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    """A tokenizer file of kind BPE with word ends: lower case, white space dropped.

    ``encode_word`` takes the longest token at each place (Aho-Corasick) and
    keeps it if it is compatible with the token before; otherwise it takes the
    next shorter one, and with none left it steps back. Two neighbours are
    compatible if merging both their strings together would give just them. A
    sequence of compatible neighbours is the one that merging gives, so no
    merge is ever carried out, and a place that failed is not tried again.
    """

    def __init__(self, spec: dict, matcher: bool = True):
        """``matcher=False`` is enough to split texts into words."""
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        if not matcher:
            return
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            made = self.vocab[a + b]
            self.pairs.setdefault((self.vocab[a], self.vocab[b]), rank)
            self.parts.setdefault(made, (self.vocab[a], self.vocab[b]))
        self.rank = {made: self.pairs[ab] for made, ab in self.parts.items()}
        self.symbols = byte_symbols()
        self._compatible: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            text = self._spelled(token)
            if self._reachable(i):
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()

    def _spelled(self, token: str) -> str:
        return token[: -len(self.suffix)] + _END if token.endswith(self.suffix) else token

    def _reachable(self, token: int) -> bool:
        """Would merging the token's own string give the token."""
        if token not in self.parts:
            return True
        a, b = self.parts[token]
        return self._reachable(a) and self._reachable(b) and self._joins(a, b, self.rank[token])

    def _joins(self, a: int, b: int, limit: int) -> bool:
        """No merge of lower rank than ``limit`` crosses the border between two tokens.

        Going back in time, the token on one side that was merged last is taken
        apart; what stands at the border then must not have been merged before.
        Equal ranks: the left one is merged first.
        """
        left, right = a, b
        top = limit
        while True:
            met = self.pairs.get((left, right))
            if met is not None and met < top:
                return False
            x, y = self.rank.get(left, -1), self.rank.get(right, -1)
            if x < 0 and y < 0:
                return True
            if x > y:
                # the left token was made by merge x: before it, only merges below x had been done
                top = min(top, x)
                left = self.parts[left][1]
            else:
                # the right token was made by merge y; a merge of the same rank to its left came first
                top = min(top, y + 1)
                right = self.parts[right][0]

    def compatible(self, a: int, b: int) -> bool:
        known = self._compatible.get((a, b))
        if known is None:
            if len(self._compatible) > 2_000_000:
                self._compatible.clear()
            known = self._compatible[a, b] = self._joins(a, b, 1 << 60)
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of byte symbols."""
        text = word + _END
        n = len(text)
        starting: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, (token, length) in self.automaton.iter(text):
            starting[last - length + 1].append((token, length))
        # matches come by their ends, so each list has its longest token last
        ids: list[int] = []
        places: list[int] = []
        tried: list[int] = []  # tokens of the place still to try
        dead = [False] * (n + 1)
        dead[n - 1] = True  # the end mark is no token of its own
        at, options = 0, len(starting[0])
        while at < n:
            moved = False
            while options:
                options -= 1
                token, length = starting[at][options]
                if not dead[at + length] and (not ids or self.compatible(ids[-1], token)):
                    ids.append(token)
                    places.append(at)
                    tried.append(options)
                    at += length
                    options = len(starting[at]) if at < n else 0
                    moved = True
                    break
            if not moved:
                dead[at] = True
                if not ids:
                    raise ValueError(f"no tokens for {word!r}")
                ids.pop()
                at, options = places.pop(), tried.pop()
        return ids

    # -- whole texts --------------------------------------------------------------

    def normalised(self, text: str) -> str:
        """A text without special tokens as its words are cut from it."""
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        lower = text.replace("Σ", "σ").lower()
        return lower.translate(_SMALL) if _WIDE.search(lower) and _CAPITAL.search(lower) else lower

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        lower = self.normalised(text)
        if lower.isascii() or not _WIDE.search(lower):
            return (_LATIN if "'" in lower else _PLAIN).findall(lower)
        odd = {ord(c): _OTHER for c in set(lower) if c > "\xff" and _unassigned(c)}
        if not odd:
            return _UNICODE.findall(lower)
        return [lower[m.start() : m.end()] for m in _UNICODE.finditer(lower.translate(odd))]

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """The text in runs of plain text and special tokens (which are marked)."""
        if self.splitter is None or "<" not in text:
            return [(text, False)]
        out, at = [], 0
        for m in self.splitter.finditer(text):
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [*out, (text[at:], False)]


class _Cache(dict):
    """Little-endian ids of words, encoded when first met; bounded."""

    def __init__(self, bpe: WordBpe, limit: int):
        super().__init__()
        self.bpe, self.limit = bpe, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        symbols = self.bpe.symbols
        ids = self.bpe.encode_word("".join([symbols[b] for b in word.encode()]))
        made = self[word] = np.array(ids, "<u4").tobytes()
        return made


def encode_text(bpe: WordBpe, cache: _Cache, text: str) -> bytes:
    """Little-endian unsigned 32-bit ids of a whole text."""
    out = []
    for piece, special in bpe.pieces(text):
        if special:
            out.append(np.array([bpe.special[piece]], "<u4").tobytes())
        else:
            out += [cache[w] for w in bpe.words(piece)]
    return b"".join(out)


class Offsets:
    """All token strings in one buffer, each with a space behind, and where they start."""

    def __init__(self, bpe: WordBpe):
        size = max(bpe.tokens) + 1
        strings = [bpe.tokens.get(i, "").encode() + b" " for i in range(size)]
        self.lengths = np.array([len(s) for s in strings])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts whose ids follow each other: tokens joined by spaces."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ids) else 0
        out = self.data[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(total)]
        stops = np.r_[0, ends][np.cumsum(counts)]
        keep = np.ones(total, bool)
        some = counts > 0
        keep[stops[some] - 1] = False  # no space behind the last token
        return out[keep], np.r_[0, stops - np.cumsum(some)]


@lru_cache(maxsize=2)
def _loaded(content: str) -> tuple[WordBpe, _Cache, Offsets]:
    bpe = WordBpe(json.loads(content))
    return bpe, _Cache(bpe, CACHE_WORDS), Offsets(bpe)


def load(path: str) -> str:
    """The tokenizer file's content: it is small, and sent to the tasks as a broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _encode(content: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache, _ = _loaded(content.value)
        for batch in batches:
            for rows in slices(batch, "text", 1 << 20):
                made = [encode_text(bpe, cache, t or "") for t in rows.column("text").to_pylist()]
                counts = pa.array([len(m) // 4 for m in made], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(made, pa.binary()), counts], ["row", "ids", "n"])

    return run


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """The columns of ``docs`` but the text, the ids of the whole text as little-endian
    unsigned 32-bit integers, and their number.

    ``tokenizer`` is the path of the file on the driver. Special tokens inside
    a text are recognised as such; none are added. Null text: no ids. Input
    columns named like the results are replaced.
    """
    require_columns(docs, text)
    content = docs.sparkSession.sparkContext.broadcast(load(tokenizer))
    others = [c for c in docs.columns if c not in (text, ids, n_tokens)]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_encode(content), f"row {kind}, ids BINARY, n LONG").select(
        *[F.col(f"row.`{c}`") for c in others], F.col("ids").alias(ids), F.col("n").alias(n_tokens)
    )


def _decode(content: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = _loaded(content.value)[2]
        for batch in batches:
            for rows in slices(batch, "ids", 1 << 20):
                raw, at = buffers(rows.column("ids"))
                data, places = offsets.decode(np.ascontiguousarray(raw).view("<u4"), np.diff(at) // 4)
                yield pa.RecordBatch.from_arrays([rows.column("row"), to_array(data, places, pa.string())], ["row", "text"])

    return run


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The columns of ``encoded`` and the text of the ids: token strings joined by spaces,
    special tokens included, as a tokenizer without a decoder gives it. Null ids: empty."""
    require_columns(encoded, ids)
    content = encoded.sparkSession.sparkContext.broadcast(load(tokenizer))
    kept = [c for c in encoded.columns if c != text]
    rows = encoded.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{ids}`").alias("ids"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_decode(content), f"row {kind}, text STRING").select(
        *[F.col(f"row.`{c}`") for c in kept], F.col("text").alias(text)
    )
