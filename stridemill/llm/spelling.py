"""Spelling variants: words one edit apart, found through a reduced alphabet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemill.schema import require_columns
from stridemill.session import stage

#: A word: letters of ASCII and Latin-1 (with the two signs that lie between them).
WORD = "[A-Za-zÀ-ÿ]+"
#: Letters are hashed to eight symbols of three bits.
BITS = 3
SYMBOLS = 1 << BITS
#: Words up to this length meet by neighbourhoods of their reduced forms (in 64 bits), longer ones by halves.
SHORT = 20

_LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))


def _lower(word: str) -> Column:
    """A to Z in lower case; other letters as they are."""
    capitals = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.when(F.col(word).rlike("[A-Z]"), F.translate(word, capitals, capitals.lower())).otherwise(F.col(word))


def word_runs(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``doc_id`` (as text) and ``word`` of every run of letters, A-Z in lower case."""
    require_columns(docs, text, id)
    runs = F.expr(f"regexp_extract_all(`{text}`, '{WORD}', 0)")
    rows = docs.select(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("run"))
    return rows.select("doc_id", _lower("run").alias("word"))


def misspell(runs: DataFrame, rate: int) -> DataFrame:
    """One letter left out of every word whose hash with its document is divisible by ``rate``."""
    hashed = runs.select("word", F.crc32(F.concat_ws(":", "doc_id", "word").cast("binary")).alias("h"))
    at = F.expr("CAST(h % length(word) AS int)")
    shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return hashed.select(F.when(F.col("h") % rate == 0, shorter).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``word`` and ``n`` of the words that are long and frequent enough; counted where they are read first."""
    long = words.where(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def reduced(word: str = "word") -> Column:
    """A word of at most ``SHORT`` letters in ``SYMBOLS`` symbols, as a number: a one, then three bits for each letter.

    A letter's symbol is its code point modulo their number.
    """
    symbols = F.translate(word, _LETTERS, "".join(str(ord(c) % SYMBOLS) for c in _LETTERS))
    return F.conv(F.concat(F.lit("1"), symbols), SYMBOLS, -10).cast("long")


def neighbourhood(r: str, length: str) -> Column:
    """A reduced word of ``length`` symbols and all that differ from it by one symbol left out, put in or
    replaced, each once."""
    symbols = ", ".join(f"{s}L" for s in range(SYMBOLS))

    def joined(above: str, symbol: str | None = None) -> str:
        """The symbols from place ``above`` up, one more if given, and those below place i."""
        below = f"({r} & (shiftleft(1L, {BITS} * i) - 1))"
        kept = f"shiftright({r}, {BITS} * {above})"
        if symbol is None:
            return f"shiftleft({kept}, {BITS} * i) | {below}"
        return f"shiftleft({kept}, {BITS} * (i + 1)) | shiftleft({symbol}, {BITS} * i) | {below}"

    places = f"sequence(0, {length} - 1)"
    without = f"transform({places}, i -> {joined('(i + 1)')})"
    other = f"flatten(transform({places}, i -> transform(array({symbols}), s -> {joined('(i + 1)', 's')})))"
    more = f"flatten(transform(sequence(0, {length}), i -> transform(array({symbols}), s -> {joined('i', 's')})))"
    return F.expr(f"array_distinct(concat(array({r}), {without}, {other}, {more}))")


def _one_edit(a: str, b: str) -> Column:
    """Exactly one code point put in, left out or replaced; ends as soon as there are more edits."""
    return F.levenshtein(F.col(a), F.col(b), 1) == 1


def _short_pairs(words: DataFrame) -> DataFrame:
    """Near words of at most ``SHORT`` code points, in both directions."""
    short = words.where(F.length("word") <= SHORT).withColumn("r", reduced())
    # spread again, because each form becomes some hundred rows
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    forms = short.select("r", F.length("word").alias("length")).distinct().repartition(tasks, "r")
    probes = forms.select(F.col("r").alias("r1"), F.explode(neighbourhood("r", "length")).alias("r"))
    # only reduced words that occur are kept, before any word meets another
    linked = probes.join(forms.select("r"), "r").select("r1", F.col("r").alias("r2"))
    ours = short.select(F.col("r").alias("r1"), "word")
    theirs = short.select(F.col("r").alias("r2"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = ours.join(linked, "r1").join(theirs, "r2")
    return met.where(_one_edit("word", "near")).select("word", "near", "near_n")


def _long_pairs(words: DataFrame) -> DataFrame:
    """Near words of which one is longer than ``SHORT``.

    Of two words one edit apart, with the shorter one ``m`` long, the first or
    the last ``m // 2`` code points agree. A word is put under both halves for
    its own length and for one less.
    """
    long = words.where(F.length("word") >= SHORT)
    size = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")
    sized = long.select("word", "n", size)
    half = F.expr("m div 2")
    ends = F.array(
        F.struct(F.lit(0).alias("end"), F.expr("substring(word, 1, m div 2)").alias("part")),
        F.struct(F.lit(1).alias("end"), F.expr("right(word, m div 2)").alias("part")),
    )
    parts = sized.where(half > 0).select("word", "n", "m", F.explode(ends).alias("e"))
    parts = parts.select("word", "n", "m", "e.end", F.md5(F.col("e.part").cast("binary")).alias("part"))
    theirs = parts.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "m", "end", "part")
    met = parts.join(theirs, ["m", "end", "part"]).where(
        (F.greatest(F.length("word"), F.length("near")) > SHORT)
        & (F.col("m") == F.least(F.length("word"), F.length("near")))
        & _one_edit("word", "near")
    )
    return met.select("word", "near", "near_n").distinct()


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n`` for all words of ``word, n`` that differ by one edit, in both directions."""
    return _short_pairs(words).unionByName(_long_pairs(words))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of each chain of forms.

    A form is at least twice as frequent, so a chain has at most as many steps
    as the largest count has binary digits; each round doubles the steps taken.
    """
    links = stage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = stage(moved, "forms")
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        links = moved.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """Each word's more frequent spelling, and the word at the end of that chain.

    ``words`` holds each ``word`` once with its count ``n``. Two words are near
    if they differ by exactly one code point put in, left out or replaced. The
    form of a word is the near word of largest count (ties: the smallest in
    code-point order), if that count is at least ``ratio`` times (2 or more)
    the word's.

    Letters are hashed to eight symbols. Every reduced word gives its full
    neighbourhood of one edit, which is joined with the reduced words that
    occur; words under linked reduced forms are then compared in full. Words of
    more than 20 code points (long runs of letters) meet by equal halves
    instead.

    Returns ``word``, ``n``, ``form``, ``root``, ``n_near``, ``form_n``.
    """
    require_columns(words, "word", "n")
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    words = stage(words.select("word", "n"), "words")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    )
    met = words.join(best, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    formed = stage(
        met.select(
            "word", "n", F.when(enough, F.col("best.near")).alias("form"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "formed",
    )
    roots = _roots(formed.where(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").select(
        "word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n"
    )


def spelling_groups(
    docs: DataFrame, text: str = "text", id: str = "doc_id", rate: int = 97, least_length: int = 5, least_count: int = 3
) -> DataFrame:
    """``group_variants`` of the words of whole texts, some of them with a letter left out.

    Null text has no words; a null id counts as an empty one; rows given twice
    count twice. Other columns play no part.
    """
    return group_variants(vocabulary(misspell(word_runs(docs, text, id), rate), least_length, least_count))
