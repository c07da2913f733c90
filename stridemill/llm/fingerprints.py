"""Document fingerprints from closed syncmers, made by column functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemill.schema import require_columns
from stridemill.session import stage

#: Bytes of an inner substring, and inner substrings of a k-mer (23 bytes then).
INNER = 8
WINDOW = 16
#: Anchors of a fingerprint: those with the smallest hashes.
SIZE = 64
#: Bytes of text looked at together; an anchor depends on its own k-mer only, so pieces need no context.
PIECE = 4096
#: Documents of one window task when each meets the next (ids and digests only).
CHUNK_ROWS = 250_000
#: Equal rows that are put out together.
COPIES = 4096

_KEY = ["none", "id", "tie"]
_HASH = (1 << 48) - 1
_RUN_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def _bind(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _minima(window: int) -> str:
    """SQL: the least of every ``window`` consecutive values of ``s``, from windows of powers of two."""
    length, made, steps = 1, "s", []
    while length < window:
        by = min(length, window - length)
        steps.append((made, f"zip_with({made}, slice({made}, {by + 1}, size({made})), (x, y) -> least(x, y))"))
        made, length = f"m{length}", length + by
    body = f"slice({made}, 1, size(s) - {window - 1})"
    for k in reversed(range(len(steps))):
        name = steps[k + 1][0] if k + 1 < len(steps) else made
        body = _bind(steps[k][1], name, body)
    return body


def _piece(number: str, inner: int, window: int, size: int | None) -> str:
    """SQL: the anchors that begin in one piece of the bytes ``b``; with ``size`` only the smallest."""
    k = inner + window - 1
    hashes = f"transform(sequence(1, length(p) - {inner - 1}), i -> xxhash64(substring(p, i, {inner})))"
    edge = f"if(x = get(s, i) OR x = get(s, i + {window - 1}), i, CAST(NULL AS int))"
    places = _bind(hashes, "s", f"array_compact(transform({_minima(window)}, (x, i) -> {edge}))")
    anchor = f"named_struct('h', xxhash64(substring(p, i + 1, {k})) & {_HASH}L, 'pos', {number} * {PIECE} + i)"
    found = f"transform({places}, i -> {anchor})"
    found = f"if(length(p) < {k}, CAST(array() AS array<struct<h: bigint, pos: int>>), {found})"
    return _bind(f"substring(b, {number} * {PIECE} + 1, {PIECE + k - 1})", "p", _least(found, size) if size else found)


def _least(anchors: str, size: int) -> str:
    """SQL: the ``size`` smallest different hashes, each with its first place."""
    fresh = "filter(a, (x, j) -> j = 0 OR x.h != get(a, j - 1).h)"
    return _bind(f"sort_array({anchors})", "a", f"slice({fresh}, 1, {size})")


def _pieces(inner: int, window: int, size: int | None) -> str:
    last = f"greatest(length(b) - {inner + window - 1}, 0) div {PIECE}"
    return f"flatten(transform(sequence(0, CAST({last} AS int)), c -> {_piece('c', inner, window, size)}))"


def anchors(text: str, inner: int = INNER, window: int = WINDOW) -> Column:
    """All closed syncmers of a text column as ``array<struct<h, pos>>``, in order of place.

    A k-mer (``inner + window - 1`` bytes of UTF-8) is chosen if the smallest
    of the hashes of its ``window`` inner substrings stands at its first or its
    last place. The choice depends on the bytes of the k-mer alone, so equal
    passages have equal anchors whatever surrounds them. ``h`` is a 48-bit hash
    of the k-mer, ``pos`` its byte. Null and texts shorter than a k-mer: none.
    """
    return F.expr(_bind(f"coalesce(CAST(`{text}` AS binary), X'')", "b", _pieces(inner, window, None)))


def sketch(text: str, inner: int = INNER, window: int = WINDOW, size: int = SIZE) -> Column:
    """``struct<h: array<long>, pos: array<int>>``: the anchors with the ``size``
    smallest different hashes, in order of hash, each with its first place.

    Every piece of the text gives its own smallest ones, of which those of the
    whole text are taken: a long text needs little memory and all of it counts.
    A text without anchors (null counts as empty) has one, the hash of the
    whole text at place 0.
    """
    one, many = _piece("0", inner, window, size), _least(_pieces(inner, window, size), size)
    found = f"if(length(b) < {PIECE + inner + window - 1}, {one}, {many})"
    whole = f"array(named_struct('h', xxhash64(b) & {_HASH}L, 'pos', 0))"
    body = "named_struct('h', transform(e, x -> x.h), 'pos', transform(e, x -> x.pos))"
    body = _bind(found, "f", _bind(f"if(size(f) = 0, {whole}, f)", "e", body))
    return F.expr(_bind(f"coalesce(CAST(`{text}` AS binary), X'')", "b", body))


def spelled(made: str) -> Column:
    """A sketch as text: ``hash@place`` in order of hash, hashes as twelve hexadecimal digits."""
    return F.expr(f"array_join(zip_with({made}.h, {made}.pos, (h, p) -> concat(lpad(lower(hex(h)), 12, '0'), '@', p)), ' ')")


def likeness(a: str, b: str, size: int = SIZE) -> Column:
    """Share of the smallest hashes of both sketches that match by hash and by place.

    Of the ``size`` smallest hashes of the union, those in both are shared. A
    shared anchor matches if it stands at the same place in both, or if its
    shift from one to the other is the shift of another shared anchor too: runs
    of text that moved as a whole count, a phrase met by chance does not. Equal
    texts have 1.
    """
    union = f"slice(array_sort(array_union({a}.h, {b}.h)), 1, {size})"
    shifts = (
        f"sort_array(transform(array_intersect(array_intersect({a}.h, {b}.h), u), "
        f"h -> get({b}.pos, CAST(array_position({b}.h, h) AS int) - 1) - get({a}.pos, CAST(array_position({a}.h, h) AS int) - 1)))"
    )
    matched = "size(filter(t, (x, j) -> x = 0 OR x <=> get(t, j - 1) OR x <=> get(t, j + 1)))"
    return F.expr(_bind(union, "u", _bind(shifts, "t", f"CAST({matched} AS double) / size(u)")))


def _keyed(docs: DataFrame, text: str, id: str) -> DataFrame:
    """Text and key of every row: no id, id, and 128 bits of the text."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    number = F.col(f"`{id}`").cast("long")
    return docs.select(
        number.isNull().alias("none"), F.coalesce(number, F.lit(0).cast("long")).alias("id"),
        F.unhex(F.md5(whole.cast("binary"))).alias("tie"), whole.alias("text"),
    )


def _chain(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Every key with the next in descending order of id, after the last the first.

    Only keys and lengths are sorted: by range partitions, written once with
    their row ids. Chunks of consecutive keys then meet the first of the chunk
    behind them. The table of partitions has one row for each.
    """
    order = [F.col("none"), F.col("id").desc(), F.col("tie")]
    keys = rows.groupBy(*_KEY).agg(F.max(F.length("text")).alias("n"))
    sorted_keys = stage(
        keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()),
        "chain",
    )
    run = F.shiftright("row", _RUN_BITS)
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = sorted_keys.groupBy(run.alias("run")).agg(F.count(F.lit(1)).alias("size"))
    runs = runs.select(
        "run", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), F.sum("size").over(Window.partitionBy()).alias("total")
    )
    place = F.col("base") + F.col("row").bitwiseAND(F.lit((1 << _RUN_BITS) - 1))
    placed = sorted_keys.withColumn("run", run).join(F.broadcast(runs), "run").withColumn("pos", place)
    home = F.floor(F.col("pos") / chunk_rows)

    def at(chunk: Column, pos: Column) -> Column:
        return F.struct(chunk.alias("chunk"), pos.cast("long").alias("pos"))

    here, total = at(home, F.col("pos")), F.col("total")
    copies = (
        F.when(F.col("pos") == 0, F.array(here, at(F.floor((total - 1) / chunk_rows), total)))
        .when(F.pmod("pos", F.lit(chunk_rows)) == 0, F.array(here, at(home - 1, F.col("pos"))))
        .otherwise(F.array(here))
    )
    spec = Window.partitionBy("chunk").orderBy("pos")
    return (
        placed.select(*_KEY, "n", "total", F.explode(copies).alias("at"))
        .select(*_KEY, "n", "total", "at.chunk", "at.pos")
        .withColumns({f"next_{c}": F.lead(c).over(spec) for c in _KEY})
        .where((F.col("pos") < F.col("total")) & (F.floor(F.col("pos") / chunk_rows) == F.col("chunk")))
        .select(*_KEY, (F.col("n") / 2).cast("long").alias("half"), *[f"next_{c}" for c in _KEY])
    )


def with_next(docs: DataFrame, text: str = "text", id: str = "doc_id", chunk_rows: int = CHUNK_ROWS, **shape: int) -> DataFrame:
    """Every row with the sketch of its text and the next document's, and its edited text.

    The next document is that of the next smaller id, after the smallest the
    largest; null ids come last, rows of one id in order of a digest of their
    text, and rows equal in both follow each other. The edited text is the text
    with its last half (half its code points, rounded down) replaced by the
    first as many code points of the next one.

    Texts move once, with their sketches, to their keys; each key then gets the
    next one's sketch and the half that it needs. Equal rows are put together
    before they move. Returns ``none``, ``id``, ``text``, ``made``,
    ``next_made``, ``edited``.
    """
    rows = _keyed(docs, text, id)
    value = F.struct("text", sketch("text", **shape).alias("made"))
    whole = rows.groupBy(*_KEY).agg(F.max(value).alias("v"), F.count(F.lit(1)).alias("copies"))
    whole = whole.select(*_KEY, "v.text", "v.made", "copies")
    # the test of the copies keeps both readings of the table alike, so that it is moved once
    senders = whole.where(F.col("copies") > 0).withColumnsRenamed({c: f"next_{c}" for c in _KEY})
    sent = senders.join(_chain(rows, chunk_rows), [f"next_{c}" for c in _KEY]).select(
        *_KEY, F.expr("substring(text, 1, CAST(half AS int))").alias("front"), F.col("made").alias("next_made")
    )
    met = whole.join(sent, _KEY)
    # of equal rows all but the last are followed by their own text
    cut = "CAST(char_length(text) div 2 AS int)"
    last = f"named_struct('front', front, 'next_made', next_made, 'times', 1L)"
    own = f"named_struct('front', substring(text, 1, {cut}), 'next_made', made, 'times', copies - 1)"
    kinds = met.select("none", "id", "text", "made", F.expr(f"explode(if(copies > 1, array({last}, {own}), array({last})))").alias("r"))
    out = kinds.select(
        "none", "id", "text", "made", "r.next_made", F.col("r.times").alias("times"),
        F.expr(f"concat(substring(text, 1, char_length(text) - {cut}), r.front)").alias("edited"),
    )
    blocks = out.withColumn("block", F.explode(F.expr(f"sequence(0L, (times - 1) div {COPIES})")))
    each = F.expr(f"sequence(1L, least({COPIES}, times - block * {COPIES}))")
    return blocks.withColumn("copy", F.explode(each)).drop("times", "block", "copy")


def fingerprints(
    docs: DataFrame, text: str = "text", id: str = "doc_id", inner: int = INNER, window: int = WINDOW, size: int = SIZE
) -> DataFrame:
    """``id``, ``n_chars`` and ``fingerprint`` (a sketch as text) of every row; no row moves.

    Null text counts as empty. Equal texts have equal fingerprints.
    """
    require_columns(docs, text, id)
    made = docs.select(
        F.col(f"`{id}`").alias("id"), F.coalesce(F.length(f"`{text}`"), F.lit(0)).cast("long").alias("n_chars"),
        sketch(text, inner, window, size).alias("made"),
    )
    return made.select(F.col("id").alias(id), "n_chars", spelled("made").alias("fingerprint"))


def compare_with_next(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    inner: int = INNER,
    window: int = WINDOW,
    size: int = SIZE,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Fingerprints of every row and of its edited text (see ``with_next``), and how alike they are.

    Returns ``id``, ``n_chars``, ``edited``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``. Rows given twice
    are returned twice; null text counts as empty; an id column with one of
    the result's names is refused; other columns are left out.
    """
    require_columns(docs, text, id)
    if id in ("n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"):
        raise ValueError(f"the id column cannot be named {id}")
    shape = {"inner": inner, "window": window, "size": size}
    rows = with_next(docs, text, id, chunk_rows, **shape).withColumn("edited_made", sketch("edited", **shape))
    return rows.select(
        F.when(~F.col("none"), F.col("id")).alias(id), F.length("text").cast("long").alias("n_chars"), "edited",
        spelled("made").alias("fingerprint"), spelled("edited_made").alias("edited_fingerprint"),
        likeness("made", "edited_made", size).alias("near_edited"), likeness("made", "next_made", size).alias("near_next"),
    )
