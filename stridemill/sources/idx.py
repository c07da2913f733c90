"""Fixed-width binary image and label files as a Spark data source.

Layout (fixed values): big-endian 32-bit magic 2051 for images, followed by
count, rows and columns; magic 2049 for labels, followed by the count; then one
unsigned byte per pixel or label.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)

from stridemill.schema import IDX_IMAGES, IDX_LABELS
from stridemill.session import fresh_path

IMAGE_MAGIC = 2051
LABEL_MAGIC = 2049
# Bytes of records one partition reads.
PARTITION_BYTES = 64 << 20
# Bytes of records per Arrow batch.
BATCH_BYTES = 4 << 20
# Headers read at a time while planning a scan of the data source.
HEADER_THREADS = 32
# Most tasks that read headers.
HEADER_TASKS = 256

_LAST = 1 << 62
_indexes: dict[tuple, str] = {}


def as_uri(path: str) -> str:
    """A path with its scheme; ``/a`` and ``file:/a`` become ``file:///a``."""
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


def _open(path: str):
    """Random access on local and remote file systems alike."""
    filesystem, name = fs.FileSystem.from_uri(as_uri(path))
    return filesystem.open_input_file(name)


def _files(path: str) -> list[str]:
    uri = as_uri(path)
    filesystem, name = fs.FileSystem.from_uri(uri)
    info = filesystem.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [uri]
    prefix = uri[: len(uri) - len(name)] if uri.endswith(name) else "file://"
    found = filesystem.get_file_info(fs.FileSelector(name))
    return sorted(
        prefix + f.path
        for f in found
        if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))
    )


@dataclass(frozen=True)
class Header:
    count: int
    rows: int
    cols: int
    offset: int

    @property
    def width(self) -> int:
        return self.rows * self.cols

    @staticmethod
    def read(path: str, kind: str) -> Header:
        with _open(path) as handle:
            size = handle.size()
            want, length = (IMAGE_MAGIC, 16) if kind == "images" else (LABEL_MAGIC, 8)
            head = handle.read(length)
        if len(head) < length:
            raise ValueError(f"{path}: too short for a header")
        magic, *numbers = struct.unpack(f">{length // 4}I", head)
        if magic != want:
            raise ValueError(f"{path}: magic {magic}, expected {want}")
        count, rows, cols = numbers if kind == "images" else (numbers[0], 1, 1)
        if size != length + count * rows * cols:
            raise ValueError(f"{path}: {size} bytes do not hold {count} records of {rows * cols}")
        return Header(count, rows, cols, length)


@dataclass
class RecordRange(InputPartition):
    path: str
    header: Header
    first: int
    last: int
    base: int


class IdxReader(DataSourceReader):
    """Reads the records at the positions that are asked for; others are not touched."""

    def __init__(self, path: str, kind: str, partition_bytes: int, index: str | None = None):
        self.path, self.kind, self.partition_bytes, self.index = path, kind, partition_bytes, index
        self.low, self.high = 0, _LAST

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of ``pos`` with a number narrow the range; all other filters stay with Spark."""
        for f in filters:
            number = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("pos",) or not isinstance(number, int):
                if isinstance(f, IsNotNull) and f.attribute == ("pos",):
                    continue  # a position is never null
                yield f
            elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, number + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, number + 1 - isinstance(f, LessThan))
            else:
                yield f

    def _headers(self) -> Iterator[tuple[str, Header, int]]:
        """Path, header and first position of every file: from the index, or else from the files themselves."""
        if self.index:
            for name in _files(self.index):
                with _open(name) as handle:
                    for row in pq.read_table(handle).to_pylist():
                        yield row["path"], Header(row["count"], row["rows"], row["cols"], row["start"]), row["base"]
            return
        base, paths = 0, _files(self.path)
        with ThreadPoolExecutor(HEADER_THREADS) as pool:
            for path, header in zip(paths, pool.map(lambda path: Header.read(path, self.kind), paths)):
                yield path, header, base
                base += header.count

    def partitions(self) -> list[RecordRange]:
        """Ranges of the wanted records."""
        out = []
        for path, header, base in self._headers():
            step = max(1, self.partition_bytes // max(1, header.width))
            low, high = max(0, self.low - base), min(header.count, self.high - base)
            out += [RecordRange(path, header, k, min(k + step, high), base) for k in range(low, high, step)]
        return out

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        header = partition.header
        step = max(1, BATCH_BYTES // max(1, header.width))
        with _open(partition.path) as handle:
            for first in range(partition.first, partition.last, step):
                n = min(step, partition.last - first)
                data = handle.read_at(n * header.width, header.offset + first * header.width)
                values = np.frombuffer(data, dtype=np.uint8)
                pos = pa.array(np.arange(n, dtype=np.int64) + partition.base + first)
                yield pa.RecordBatch.from_arrays([pos, self._column(values, n, header)], names=self._names())

    def _names(self) -> list[str]:
        return ["pos", "image" if self.kind == "images" else "label"]

    def _column(self, values: np.ndarray, n: int, header: Header) -> pa.Array:
        if self.kind == "labels":
            return pa.array(values.astype(np.int64))
        pixels = pa.array(values.astype(np.int16))
        lines = pa.ListArray.from_arrays(
            pa.array(np.arange(n * header.rows + 1, dtype=np.int32) * header.cols), pixels
        )
        return pa.ListArray.from_arrays(
            pa.array(np.arange(n + 1, dtype=np.int32) * header.rows), lines
        )


class IdxDataSource(DataSource):
    """``format("idx")`` with options ``kind`` (images or labels), ``partitionBytes`` and
    ``index`` (a table of the files' headers, as ``read_idx`` makes it)."""

    @classmethod
    def name(cls) -> str:
        return "idx"

    def _kind(self) -> str:
        kind = self.options.get("kind", "images")
        if kind not in ("images", "labels"):
            raise ValueError("kind must be 'images' or 'labels'")
        return kind

    def schema(self) -> str:
        return IDX_IMAGES if self._kind() == "images" else IDX_LABELS

    def reader(self, schema) -> IdxReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("the idx source needs a path")
        size = int(self.options.get("partitionBytes", PARTITION_BYTES))
        return IdxReader(path, self._kind(), size, self.options.get("index"))


def read_idx(
    spark: SparkSession, path: str, kind: str = "images", partition_bytes: int = PARTITION_BYTES
) -> DataFrame:
    """Records of a file, or of all files of a folder in name order.

    Headers are read once, in tasks, into an index that later calls for the same
    files use again. Filters on ``pos`` reach the source, which then reads only
    those records; the setting that allows it is switched on in the session.
    """
    spark.dataSource.register(IdxDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("idx").option("kind", kind).option("index", _indexed(spark, path, kind))
    return reader.option("partitionBytes", partition_bytes).load(path)


def _indexed(spark: SparkSession, path: str, kind: str) -> str:
    """The table of the headers of all files, written once for each state of the files."""
    filesystem, name = fs.FileSystem.from_uri(as_uri(path))
    info = filesystem.get_file_info(name)
    found = filesystem.get_file_info(fs.FileSelector(name)) if info.type == fs.FileType.Directory else [info]
    state = hash(tuple(sorted((f.path, f.size, f.mtime_ns) for f in found)))
    key = (spark.sparkContext.applicationId, path, kind, state)
    if key not in _indexes:
        rows = [(f.path, f.header.count, f.header.rows, f.header.cols, f.header.offset, f.base) for f in locate(spark, path, kind)]
        schema = "path STRING, count LONG, rows LONG, cols LONG, start LONG, base LONG"
        target = fresh_path(spark, "idx-index")
        spark.createDataFrame(rows, schema).coalesce(1).sortWithinPartitions("base", "path").write.parquet(target)
        _indexes[key] = target
    return _indexes[key]


@dataclass(frozen=True)
class Located:
    """The header of a file, and the position of its first record among all files."""

    path: str
    header: Header
    base: int


def locate(spark: SparkSession, path: str, kind: str) -> list[Located]:
    """Headers of all files in name order, read in tasks; one row per file comes back."""
    paths = _files(path)
    if not paths:
        return []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"ix": r["ix"], "count": h.count, "rows": h.rows, "cols": h.cols, "start": h.offset}
                for r in batch.to_pylist()
                for h in [Header.read(r["path"], kind)]
            ]
            kinds = pa.schema([(c, pa.int64()) for c in ("ix", "count", "rows", "cols", "start")])
            yield pa.RecordBatch.from_pylist(rows, kinds)

    listed = spark.createDataFrame(list(enumerate(paths)), "ix LONG, path STRING")
    tasks = min(len(paths), HEADER_TASKS)
    found = listed.repartition(tasks).mapInArrow(read, "ix LONG, count LONG, rows LONG, cols LONG, start LONG")
    out, base = [], 0
    for row in sorted(found.collect()):
        ix, count, rows, cols, start = row
        out.append(Located(paths[ix], Header(count, rows, cols, start), base))
        base += count
    return out


def read_labelled_images(
    spark: SparkSession, images: str, labels: str, partition_bytes: int = PARTITION_BYTES
) -> DataFrame:
    """Images with the labels at the same positions; both are read by the same task.

    The files of the two kinds may be cut differently, but must hold as many
    records. Ranges are dealt evenly over as many tasks as the bytes ask for,
    so many small files do not make many tasks.
    """
    pictures, marks = locate(spark, images, "images"), locate(spark, labels, "labels")
    counts = [sum(f.header.count for f in fs) for fs in (pictures, marks)]
    if counts[0] != counts[1]:
        raise ValueError(f"{counts[0]} images and {counts[1]} labels")
    ends = np.cumsum([f.header.count for f in marks])
    ranges, size = [], 0
    for f in pictures:
        step = max(1, partition_bytes // max(1, f.header.width))
        for first in range(0, f.header.count, step):
            n = min(step, f.header.count - first)
            low, parts = f.base + first, []
            k = int(np.searchsorted(ends, low, "right"))
            while low < f.base + first + n:
                take = min(int(ends[k]), f.base + first + n) - low
                parts.append((marks[k].path, marks[k].header.offset + low - marks[k].base, take))
                low, k = low + take, k + 1
            ranges.append((f.path, f.header.offset + first * f.header.width, n, f.header.rows, f.header.cols, f.base + first, parts))
            size += n * f.header.width

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = IdxReader(images, "images", partition_bytes)
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as handle:
                    label = np.concatenate([_bytes(p["path"], p["start"], p["n"]) for p in row["labels"]])
                    header = Header(row["n"], row["rows"], row["cols"], row["start"])
                    step = max(1, BATCH_BYTES // max(1, header.width))
                    for first in range(0, row["n"], step):
                        n = min(step, row["n"] - first)
                        data = handle.read_at(n * header.width, header.offset + first * header.width)
                        pixels = reader._column(np.frombuffer(data, np.uint8), n, header)
                        pos = pa.array(np.arange(n, dtype=np.int64) + row["pos"] + first)
                        own = pa.array(label[first : first + n].astype(np.int64))
                        yield pa.RecordBatch.from_arrays([pos, pixels, own], ["pos", "image", "label"])

    schema = (
        "path STRING, start LONG, n LONG, rows INT, cols INT, pos LONG, "
        "labels ARRAY<STRUCT<path: STRING, start: LONG, n: LONG>>"
    )
    table = spark.createDataFrame(ranges, schema).repartition(max(1, -(-size // partition_bytes)))
    return table.mapInArrow(read, f"{IDX_IMAGES}, label LONG")


def _bytes(path: str, start: int, n: int) -> np.ndarray:
    with _open(path) as handle:
        return np.frombuffer(handle.read_at(n, start), np.uint8)


def idx_bytes(records: np.ndarray) -> bytes:
    """The file content for an ``(n, rows, cols)`` image or ``(n,)`` label array."""
    if records.ndim == 3:
        head = struct.pack(">4I", IMAGE_MAGIC, *records.shape)
    elif records.ndim == 1:
        head = struct.pack(">2I", LABEL_MAGIC, len(records))
    else:
        raise ValueError("need an (n, rows, cols) or an (n,) array")
    return head + np.ascontiguousarray(records, dtype=np.uint8).tobytes()


def convert_once(
    spark: SparkSession,
    raw: dict[str, tuple[str, str]],
    processed: str,
) -> DataFrame:
    """Parse ``{split: (images, labels)}`` the first time, reuse parquet later.

    The copy is used only if the write was committed (its ``_SUCCESS`` mark) and
    every split is there; the ``split`` column is the partition column on disk.
    """
    finished = _there(spark, f"{processed}/_SUCCESS") and all(
        _there(spark, f"{processed}/split={split}") for split in raw
    )
    if not finished:
        parsed = None
        for split, (images, labels) in raw.items():
            part = read_labelled_images(spark, images, labels).withColumn("split", F.lit(split))
            parsed = part if parsed is None else parsed.unionByName(part)
        parsed.write.mode("overwrite").partitionBy("split").parquet(processed)
    return spark.read.parquet(processed)


def _there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
