"""Near-duplicate documents: weighted MinHash of TF-IDF word shingles, banded and verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemill.llm.graph import components
from stridemill.llm.text import buffers, hash_spans, mix, slices, to_array, window_hashes, word_spans
from stridemill.schema import require_columns
from stridemill.session import stage

#: Buckets of hashed words whose document frequency is counted: the table that is broadcast has this size.
WORD_BITS = 18
#: Members of a band bucket that meet in one task.
BLOCK = 512
_BASE = 0x9E6C63D0876A9A45
_NO_ID = -(2**63)


@dataclass(frozen=True)
class Settings:
    """``bands`` times ``rows`` samples; a pair is compared if a band agrees and, of all
    samples, the share ``screen`` at least (3.4 standard deviations below ``similarity``)."""

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 10
    rows: int = 3
    screen: float = 17 / 30
    seed: int = 7


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per word bucket, summed over the task."""
    counts = np.zeros(1 << WORD_BITS, np.int64)
    for batch in batches:
        for rows in slices(batch, "text"):
            data, offsets = buffers(rows.column("text"))
            begin, end, first = word_spans(data, offsets)
            bucket = hash_spans(data, begin, end) >> np.uint64(64 - WORD_BITS)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first)).astype(np.uint64)
            each = np.unique(doc << np.uint64(WORD_BITS) | bucket) & np.uint64((1 << WORD_BITS) - 1)
            counts += np.bincount(each.astype(np.int64), minlength=len(counts))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["bucket", "n"])


def word_idf(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Inverse document frequency per bucket of hashed words over all documents, from 1 to 2.

    ``1 + ln((1 + N) / (1 + n)) / ln(1 + N)`` for n of N documents; a table of
    ``2**WORD_BITS`` numbers whatever the size of the corpus.
    """
    rows = docs.select(F.col(f"`{text}`").alias("text"))
    total = rows.count()
    counts = np.zeros(1 << WORD_BITS, np.float64)
    found = rows.mapInArrow(_word_counts, "bucket INT, n LONG").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    if not total:
        return np.ones(1 << WORD_BITS, np.float32)
    return (1 + np.log((1 + total) / (1 + counts)) / np.log(1 + total)).astype(np.float32)


def shingles(column: pa.Array, idf: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, their TF-IDF weights, and the first one of each text.

    A shingle's weight is its count in the text times the mean idf of its words.
    A text of fewer words has one shingle of all of them; one without words has none.
    """
    data, offsets = buffers(column)
    begin, end, first = word_spans(data, offsets)
    words = hash_spans(data, begin, end)
    weight = idf[words >> np.uint64(64 - WORD_BITS)].astype(np.float64)
    n = np.diff(first)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    heads = np.cumsum(counts) - counts
    total = int(counts.sum())
    at = np.repeat(first[:-1] - heads, counts) + np.arange(total)
    full = np.repeat(n >= size, counts)
    sums = np.r_[0, np.cumsum(weight)]
    length = np.where(full, size, np.repeat(n, counts))
    mean = (sums[at + length] - sums[at]) / np.maximum(length, 1)
    features = np.zeros(total, np.uint64)
    windows = window_hashes(words, size, _BASE)
    features[full] = windows[at[full]]
    short = np.flatnonzero(~full)
    for k in range(1, size):
        more = short[length[short] >= k]
        features[more] = mix(features[more] + words[at[more] + k - 1] + np.uint64(k))
    features = mix(features)
    doc = np.repeat(np.arange(len(n)), counts)
    key = mix(features ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.r_[np.ones(min(1, total), bool), key[order][1:] != key[order][:-1]])
    times = np.diff(np.r_[new, total])
    leader = order[new]  # the sort is stable: the first time in the text
    back = np.argsort(leader, kind="stable")
    leader, times = leader[back], times[back]
    return features[leader], mean[leader] * times, np.searchsorted(doc[leader], np.arange(len(n) + 1))


def consistent_samples(features: np.ndarray, weights: np.ndarray, first: np.ndarray, count: int, seed: int) -> np.ndarray:
    """``count`` improved consistent weighted samples of each text, as 32-bit hashes of (shingle, t).

    For a shingle of weight s: r, c from Gamma(2, 1), b from U(0, 1), all set by
    the shingle and the sample; t = floor(ln s / r + b); the shingle with the
    least ln a = ln c - r (t - b + 1) is drawn. Two texts agree in a sample with
    the probability of their weighted Jaccard similarity. The random numbers
    are looked up by 16 bits each of one hash. Texts without shingles give 0.
    """
    drawn = np.random.default_rng(seed)
    gamma = drawn.standard_gamma(2, 1 << 16).astype(np.float32)
    log_c = np.log(drawn.standard_gamma(2, 1 << 16)).astype(np.float32)
    keys = drawn.integers(1, 2**63, (count, 2), dtype=np.int64).astype(np.uint64) | np.uint64(1)
    out = np.zeros((len(first) - 1, count), np.uint32)
    some = np.flatnonzero(np.diff(first))
    if not len(some):
        return out
    heads = first[:-1][some]
    sizes = np.diff(first)[some]
    log_w = np.log(weights).astype(np.float32)
    low = np.uint64(0xFFFF)
    for j in range(count):
        x = (features ^ keys[j, 0]) * keys[j, 1]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        r = gamma[x & low]
        b = ((x >> np.uint64(48)).astype(np.float32) + np.float32(0.5)) / np.float32(65536)
        t = np.floor(log_w / r + b)
        a = log_c[(x >> np.uint64(16)) & low] - r * (t - b + 1)
        hit = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, heads), sizes))
        at = hit[np.searchsorted(hit, heads)]
        out[some, j] = mix(features[at] + (t[at].astype(np.int64).astype(np.uint64) * keys[j, 1])) >> np.uint64(32)
    return out


def _sign(idf: Broadcast, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                features, weights, first = shingles(rows.column("text"), idf.value, settings.shingle)
                samples = consistent_samples(features, weights, first, settings.bands * settings.rows, settings.seed)
                grouped = samples.reshape(-1, settings.bands, settings.rows).astype(np.uint64)
                bands = np.zeros(grouped.shape[:2], np.uint64) + mix(np.arange(settings.bands, dtype=np.uint64))
                for k in range(settings.rows):
                    bands = mix(bands ^ grouped[:, :, k])
                some = np.diff(first) > 0
                lists = np.r_[0, np.cumsum(some * settings.bands)].astype(np.int32)
                width = samples.shape[1] * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("id"),
                        rows.column("digest"),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(bands[some].reshape(-1).view(np.int64))),
                        to_array(samples.reshape(-1).view(np.uint8), np.arange(len(samples) + 1) * width, pa.binary()),
                    ],
                    ["id", "digest", "bands", "samples"],
                )

    return run


class _Group:
    """The members of one bucket block, compared as soon as the next block begins."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.ids, self.labels, self.sides, self.samples, self.parts = [], [], [], [], []

    def add(self, rows: dict, k: int, features: np.ndarray, weights: np.ndarray) -> None:
        self.ids.append(rows["id"][k])
        self.labels.append(rows["label"][k])
        self.sides.append(rows["side"][k])
        self.samples.append(rows["samples"][k])
        self.parts.append((features, weights))

    def links(self) -> list[tuple[int, int]]:
        """Similar members of different labels: a forest, not all pairs."""
        n = len(self.ids)
        if n < 2:
            return []
        root = {label: label for label in self.labels}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        samples = np.stack(self.samples)
        sides = np.array(self.sides)
        sizes = np.array([len(f) for f, _ in self.parts])
        _, index = np.unique(np.concatenate([f for f, _ in self.parts]), return_inverse=True)
        weights = np.concatenate([w for _, w in self.parts])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        whole = np.add.reduceat(weights, begins)
        dense = np.zeros(int(index.max()) + 1)
        least = self.settings.screen * samples.shape[1] - 1e-9
        found = []
        for i in range(n - 1):
            mine = find(self.labels[i])
            agree = (samples[i + 1 :] == samples[i]).sum(1) >= least
            if sides[i] >= 0:  # across two blocks: the others stand in the other block
                agree &= sides[i + 1 :] != sides[i]
            others = [int(j) + i + 1 for j in np.flatnonzero(agree) if find(self.labels[int(j) + i + 1]) != mine]
            if not others:
                continue
            j = np.array(others)
            own = slice(begins[i], ends[i])
            dense[index[own]] = weights[own]
            at = np.repeat(begins[j] - np.r_[0, np.cumsum(sizes[j])[:-1]], sizes[j]) + np.arange(sizes[j].sum())
            shared = np.add.reduceat(np.minimum(dense[index[at]], weights[at]), np.r_[0, np.cumsum(sizes[j])[:-1]])
            dense[index[own]] = 0
            alike = shared / (whole[i] + whole[j] - shared)
            for other in j[alike >= self.settings.similarity - 1e-9].tolist():
                a, b = find(self.labels[i]), find(self.labels[other])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    found.append((self.ids[i], self.ids[other]))
        return found


def _verify(idf: Broadcast, settings: Settings):
    """Links within each (bucket, block); the rows come sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, _Group(settings)
        for batch in batches:
            found: list[tuple[int, int]] = []
            for part in slices(batch, "text"):
                features, weights, first = shingles(part.column("text"), idf.value, settings.shingle)
                rows = {c: part.column(c).to_pylist() for c in ("bucket", "block", "id", "label", "side")}
                raw, _ = buffers(part.column("samples"))
                rows["samples"] = np.ascontiguousarray(raw).view(np.uint32).reshape(part.num_rows, -1)
                for k in range(part.num_rows):
                    here = (rows["bucket"][k], rows["block"][k])
                    if here != at:
                        found += group.links()
                        at, group = here, _Group(settings)
                    group.add(rows, k, features[first[k] : first[k + 1]], weights[first[k] : first[k + 1]])
            yield _pairs(found)
        yield _pairs(group.links())

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


def _compare(members: DataFrame, texts: DataFrame, idf: Broadcast, settings: Settings) -> DataFrame:
    """Links among ``members`` (id, label, bucket, block, side): a text is moved once per block it is in."""
    places = members.groupBy("id", "label").agg(F.collect_list(F.struct("bucket", "block", "side")).alias("at"))
    rows = texts.join(places, "id").select("id", "label", "samples", "text", F.explode("at").alias("at"))
    rows = rows.select("id", "label", "samples", "text", "at.*")
    return (
        rows.repartition("bucket", "block")
        .sortWithinPartitions("bucket", "block", "id")
        .mapInArrow(_verify(idf, settings), "a LONG, b LONG")
    )


def _strangers(labelled: DataFrame, block: int) -> DataFrame:
    """Members (id, label, bucket, block, side) of the second round: who meets whom among the members of cut buckets.

    The class that holds most of a bucket needs no comparison within itself:
    its members stay in their blocks, and only the others, the strangers, are
    dealt to blocks of their own. Every stranger block meets every block of the
    bucket and every other stranger block; a group holds two blocks at most.
    Buckets of one class are left out.
    """
    sizes = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    per = sizes.groupBy("bucket").agg(
        F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("label")).alias("less"))).alias("top")
    ).select("bucket", (-F.col("top.less")).alias("main"), (F.col("all") - F.col("top.n")).alias("strangers"))
    rows = labelled.join(per.where("strangers > 0"), "bucket")
    count = F.ceil(F.col("strangers") / block)  # blocks of strangers
    own = F.pmod(F.xxhash64(F.lit(2), "id"), count)
    half = F.lit(1 << 31)
    # the block of a group: resident block and stranger block, or below zero two stranger blocks
    residents = rows.where("label = main").select(
        "id", "label", "bucket", F.col("block").cast("long").alias("home"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("other")
    ).select("id", "label", "bucket", (F.col("home") * half + F.col("other")).alias("block"), F.lit(0).alias("side"))
    strangers = rows.where("label != main").withColumn("own", own).withColumn("count", count)
    homes = rows.where("label = main").select("bucket", "block").distinct()
    visits = strangers.join(homes.withColumnRenamed("block", "home"), "bucket").select(
        "id", "label", "bucket", (F.col("home").cast("long") * half + F.col("own")).alias("block"), F.lit(1).alias("side")
    )
    among = strangers.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))).select(
        "id", "label", "bucket",
        (-(F.least("own", "other") * half + F.greatest("own", "other")) - 1).alias("block"),
        F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    return residents.unionByName(visits).unionByName(among)


def near_duplicates(
    docs: DataFrame, text: str = "text", id: str = "doc_id", settings: Settings = Settings(), block: int = BLOCK
) -> DataFrame:
    """``id``, ``class_id`` (smallest id of the class) and ``kept`` for every row of ``docs``.

    Classes are connected by pairs whose TF-IDF shingles have a weighted Jaccard
    similarity of ``settings.similarity`` or more. Equal texts are put together
    first. Distinct texts are signed by improved consistent weighted sampling,
    bucketed by bands, and all members of a bucket whose samples agree well
    enough are compared exactly, unless they are known to be of one class. A
    bucket above ``block`` members is cut into blocks that share its first
    member; in a second round, members that are not of the class holding most of
    their bucket are compared with all its blocks (``_strangers``). Buckets of the same members are
    compared once. Links leave a task as a forest, never as all pairs.

    Null text: alike with nothing, a class of its own. Texts without words are
    alike only if equal. A null id counts as the smallest one. Rows that repeat
    id and text are one document; rows of one id with different texts are
    different documents and share a class only if their texts do. ``kept`` is
    true for one document of each class.
    """
    if id in ("class_id", "kept"):
        raise ValueError(f"the id column cannot be named {id}")
    plain = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return _classes(docs, text, id, settings, block).select(
        plain("id").alias(id), plain("class_id").alias("class_id"), "kept"
    )


def _keys(text: str, id: str) -> tuple[Column, Column]:
    """What tells documents apart: the id, and the digest of the text (null for a null text)."""
    return F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(_NO_ID)), F.unhex(F.md5(F.col(f"`{text}`").cast("binary")))


def _classes(docs: DataFrame, text: str, id: str, settings: Settings, block: int) -> DataFrame:
    """``id`` (never null), ``digest``, ``class_id`` and ``kept`` for every row of ``docs``."""
    require_columns(docs, text, id)
    spark = docs.sparkSession
    key, digest = _keys(text, id)
    rows = docs.select(key.alias("id"), F.col(f"`{text}`").alias("text"), digest.alias("digest"))
    idf = spark.sparkContext.broadcast(word_idf(rows))
    signed = stage(
        rows.where("text IS NOT NULL").mapInArrow(
            _sign(idf, settings), "id LONG, digest BINARY, bands ARRAY<LONG>, samples BINARY"
        ),
        "signatures",
    )
    # texts are numbered: ids may be null or stand for several texts
    texts = stage(
        signed.groupBy("digest")
        .agg(F.min("id").alias("low"), F.first("bands").alias("bands"), F.first("samples").alias("samples"))
        .withColumn("rep", F.monotonically_increasing_id()),
        "texts",
    )
    placed = texts.select(F.explode("bands").alias("bucket"), F.col("rep").alias("id"))
    buckets = (
        placed.groupBy("bucket")
        .agg(
            F.count("*").alias("size"),
            F.min("id").alias("low"),
            F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h1"),
            F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("h2"),
        )
        .where("size > 1")
        .groupBy("size", "low", "h1", "h2")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket", "low", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    )
    members = placed.join(buckets, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    members = stage(members.dropDuplicates(["bucket", "id"]), "members")
    first = F.when(
        (F.col("blocks") > 1) & (F.col("id") == F.col("low")), F.sequence(F.lit(0), F.col("blocks") - 1)
    ).otherwise(F.array("block"))
    # the texts that share a bucket with another one: moved once, then kept beside their samples
    known = texts.select(F.col("rep").alias("id"), "low", "digest", "samples").join(members.select("id").distinct(), "id")
    bodies = rows.withColumnRenamed("id", "low").join(known, ["low", "digest"]).select("id", "text", "samples")
    if _repeated(signed):
        bodies = bodies.dropDuplicates(["id"])
    bodies = stage(bodies, "bodies")
    links = stage(
        _compare(
            members.select("id", F.col("id").alias("label"), "bucket", F.explode(first).alias("block"), F.lit(-1).alias("side")),
            bodies, idf, settings,
        ),
        "similar",
    )
    cut = members.where("blocks > 1").select("bucket", "id", "block")
    if not cut.isEmpty():
        known = components(links)
        labelled = cut.join(known, cut["id"] == known["node"], "left").select(
            "bucket", "block", "id", F.coalesce("component", "id").alias("label")
        )
        links = stage(links.unionByName(_compare(_strangers(labelled, block), bodies, idf, settings)), "similar")
    classes = components(links)
    grouped = texts.join(classes, texts["rep"] == classes["node"], "left").select(
        "digest", "low", F.coalesce("component", "rep").alias("class")
    )
    first_of = grouped.groupBy("class").agg(F.min(F.struct("low", "digest")).alias("first"))
    named = grouped.join(first_of, "class").select("digest", "first")
    worded = signed.select("id", "digest").join(named, "digest").select(
        "id", "digest", F.col("first.low").alias("class_id"), (F.struct("id", "digest") == F.struct("first.low", "first.digest")).alias("kept")
    )
    without = rows.where("text IS NULL").select("id", "digest", F.col("id").alias("class_id"), F.lit(True).alias("kept"))
    return worded.unionByName(without)


def _repeated(signed: DataFrame) -> bool:
    """Is there a document given more than once."""
    return not signed.groupBy("id", "digest").count().where("count > 1").isEmpty()


def drop_near_duplicates(
    docs: DataFrame, text: str = "text", id: str = "doc_id", settings: Settings = Settings()
) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id, given once."""
    none = F.lit(b"")
    found = _classes(docs, text, id, settings, BLOCK).where("kept")
    kept = stage(found.select(F.col("id").alias("__kept"), F.coalesce("digest", none).alias("__text")), "kept")
    key, digest = _keys(text, id)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that no name of theirs is met
    out = docs.select(row, key.alias("__id"), F.coalesce(digest, none).alias("__digest")).join(
        kept, (F.col("__id") == F.col("__kept")) & (F.col("__digest") == F.col("__text")), "left_semi"
    )
    if not kept.groupBy("__kept", "__text").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["__id", "__digest"])
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns])
