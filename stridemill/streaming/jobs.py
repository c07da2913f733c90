"""Structured Streaming forms of running errors, slices, samples and log sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from stridemill.functions.metrics import Metric, finish_states, partial_states, resolve
from stridemill.schema import names
from stridemill.streaming.latest import LatestTable

_STORE = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
#: Groups of keys that share their state in look-ahead samples.
SHARDS = 128
#: Values of samples that a task hands on at a time.
FRAME_VALUES = 1 << 20


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which writes changes only."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


@contextmanager
def state_partitions(spark: SparkSession, most: int) -> Iterator[None]:
    """Queries started inside have at most ``most`` partitions of state.

    Every partition costs each micro-batch a task with a state store of its
    own, empty or not, and streams do not join small ones.
    """
    before = spark.conf.get(_PARTITIONS)
    spark.conf.set(_PARTITIONS, str(max(1, min(int(before), most))))
    try:
        yield
    finally:
        spark.conf.set(_PARTITIONS, before)


def read_files(
    spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int | None = None
) -> DataFrame:
    """A parquet folder as a stream; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def running_metric_states(
    stream: DataFrame,
    metrics: Sequence[str | Metric],
    yhat: str = "prediction",
    y: str = "target",
    by: str | Sequence[str] = (),
) -> DataFrame:
    """Mergeable metric states per group over everything that arrived.

    Rows are combined before the shuffle, so the state holds one row per group.
    """
    return partial_states(stream, metrics, yhat, y, by)


def write_latest(states: DataFrame, keys: str | Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Update-mode sink: the newest row of each key, in a ``LatestTable``.

    A batch that is run again changes nothing, so the result is exact.
    """
    table = LatestTable(states.sparkSession, path, names(keys))
    with rocksdb(states.sparkSession):
        return (
            states.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(table.commit)
            .start()
        )


def read_latest(
    spark: SparkSession, path: str, metrics: Sequence[str | Metric], by: str | Sequence[str]
) -> DataFrame:
    """The metrics of each group as of its last update."""
    keys = names(by)
    return finish_states(LatestTable(spark, path, keys).read(), resolve(metrics), keys)


def hopping_slices(
    stream: DataFrame,
    time: str,
    value: str,
    length: str,
    stride: str,
    delay: str,
    start: str = "0 seconds",
) -> DataFrame:
    """Count and sum per event-time slice; rows later than ``delay`` are dropped.

    ``start`` shifts the slices against the epoch, so that they begin where the
    batch form begins.
    """
    event_time = F.col(time).cast("timestamp")
    return (
        stream.withColumn("__t", event_time)
        .withWatermark("__t", delay)
        .groupBy(F.window("__t", length, stride, start).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("slice_start"), "n", "total")
    )


def _millis(spark: SparkSession, span: str) -> int:
    """Milliseconds of an interval such as ``6 hours``."""
    epoch = F.timestamp_seconds(F.lit(0))
    return spark.range(1).select(F.unix_millis(epoch + F.expr(f"INTERVAL {span}"))).first()[0]


_WAITING = pa.schema([("key", pa.string()), ("micros", pa.int64()), ("tie", pa.int64()), ("value", pa.float64())])
_TAILS = pa.schema([("key", pa.string()), ("seen", pa.int64()), ("vals", pa.list_(pa.float64()))])


def _stored(batch: pa.RecordBatch) -> tuple[bytes]:
    """A batch as a value of the state."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return (out.getvalue().to_pybytes(),)


def _restored(value: tuple[bytes]) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(bytes(value[0]))) as reader:
        return reader.read_next_batch()


def _doubles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, zero where there is none, and where that is; NaN is a value."""
    return column.fill_null(0.0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


class _Lookahead(StatefulProcessor):
    """Rows of a shard of keys wait in buckets of event time; a bucket's timer sorts and cuts it for all its keys.

    State: Arrow batches of waiting rows by (bucket, number), the number of
    batches of each bucket, and one batch of the keys' last values. New rows add
    batches, and only the bucket whose timer has passed is read and removed, so
    a micro-batch costs what is new and what is ready, and calls to the state
    and to numpy are per shard and bucket, however many keys there are.
    """

    def __init__(self, seq_len: int, look_ahead: int, bucket: int, output: T.StructType):
        self.seq_len, self.reach, self.bucket, self.names = seq_len, seq_len + look_ahead - 1, bucket, output.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "bucket LONG, number INT", "rows BINARY")
        self.counts = handle.getMapState("counts", "bucket LONG", "n INT")
        self.tails = handle.getValueState("tails", "rows BINARY")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for new in rows:
            columns = [
                pa.array(new["key"], pa.string()), pa.array(new["micros"], pa.int64()), pa.array(new["tie"], pa.int64()),
                pa.array(new["value"].to_numpy(float), mask=new["gone"].to_numpy(bool)),
            ]
            bucket = new["micros"].to_numpy(np.int64) // (self.bucket * 1000)
            order = np.argsort(bucket, kind="stable")
            batch = pa.RecordBatch.from_arrays(columns, schema=_WAITING).take(pa.array(order))
            found, first = np.unique(bucket[order], return_index=True)
            for at, i, j in zip(found.tolist(), first.tolist(), [*first.tolist()[1:], len(order)]):
                n = (self.counts.getValue((at,)) or (0,))[0]
                self.chunks.updateValue((at, n), _stored(batch.slice(i, j - i)))
                self.counts.updateValue((at,), (n + 1,))
                if not n:
                    self.handle.registerTimer((at + 1) * self.bucket)
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() // self.bucket - 1
        parts = []
        for number in range(self.counts.getValue((at,))[0]):
            parts.append(_restored(self.chunks.getValue((at, number))))
            self.chunks.removeKey((at, number))
        self.counts.removeKey((at,))
        none = pa.RecordBatch.from_pylist([], schema=_TAILS)
        tails, made = self._cut(_restored(self.tails.get()) if self.tails.exists() else none, pa.Table.from_batches(parts))
        self.tails.update(_stored(tails))
        return made

    def _cut(self, tails: pa.RecordBatch, new: pa.Table) -> tuple[pa.RecordBatch, Iterator[pd.DataFrame]]:
        """The keys' last values after the new rows, and the samples that end in these."""
        coded = pa.concat_arrays([tails.column("key"), *new.column("key").chunks]).dictionary_encode()
        known, keys = tails.num_rows, coded.dictionary  # known keys come first, each once
        mine = coded.indices.to_numpy()[known:].astype(np.int64)
        seen, before = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        seen[:known] = tails.column("seen").to_numpy()
        before[:known] = np.diff(tails.column("vals").offsets.to_numpy())
        order = np.lexsort((new.column("tie").to_numpy(), new.column("micros").to_numpy(), mine))
        old, fresh = _doubles(tails.column("vals").flatten()), _doubles(new.column("value").combine_chunks())
        # by key: its last values, then its new rows in their order
        code = np.concatenate([np.repeat(np.arange(known), before[:known]), mine[order]])
        place = np.argsort(code, kind="stable")
        code = code[place]
        series, holes = (np.concatenate([a, b[order]])[place] for a, b in zip(old, fresh))
        count = np.bincount(code, minlength=len(keys))
        within = np.arange(len(code)) - (np.cumsum(count) - count)[code]
        ends = np.flatnonzero((place >= len(old[0])) & (within >= self.reach))
        kept = within >= count[code] - self.reach
        last = pa.array(series[kept], mask=holes[kept])
        sizes = np.r_[0, np.cumsum(np.minimum(count, self.reach))].astype(np.int32)
        now = [keys, pa.array(seen + np.bincount(mine, minlength=len(keys))), pa.ListArray.from_arrays(sizes, last)]
        pos = (seen - before)[code[ends]] + within[ends] - self.reach
        return pa.RecordBatch.from_arrays(now, schema=_TAILS), self._frames(keys, code, series, holes, ends, pos)

    def _frames(self, keys, code, series, holes, ends, pos) -> Iterator[pd.DataFrame]:
        # null and NaN are told by a code, since pandas cannot tell them apart
        odd = np.where(holes, 1, np.where(np.isnan(series), 2, 0)).astype(np.int8)
        plain = np.where(odd > 0, 0.0, series)
        labels = np.array(keys.to_pylist(), object)
        step = max(1, FRAME_VALUES // self.seq_len)
        for k in range(0, len(ends), step):
            at = ends[k : k + step]
            x, marks = (np.lib.stride_tricks.sliding_window_view(a, self.seq_len)[at - self.reach] for a in (plain, odd))
            codes = np.full(len(at), None, object)  # none: all are plain values
            for i in np.flatnonzero(marks.any(1)).tolist():
                codes[i] = marks[i]
            made = [labels[code[at]], pos[k : k + step], list(x), codes, plain[at], odd[at]]
            yield pd.DataFrame(dict(zip(self.names, made)))

    def close(self) -> None:
        pass


def lookahead_samples(
    stream: DataFrame,
    value: str,
    seq_len: int,
    look_ahead: int,
    key: str,
    time: str,
    tie: str | None = None,
    delay: str = "0 seconds",
    bucket: str | None = None,
    shards: int = SHARDS,
) -> DataFrame:
    """Look-ahead samples per key in event-time order, whatever order rows arrive in.

    A row waits with the other rows of its shard of keys and ``bucket`` of event
    time (eight times the delay, at least a second, unless given) until the
    watermark (latest ``time`` less ``delay``) has passed the bucket's end;
    then they are sorted by key, ``time`` and ``tie`` (a number) and cut. Beside
    waiting rows, a key keeps its last ``seq_len + look_ahead - 1`` values.
    Keys are dealt to ``shards`` by a hash. A task holds the rows of one shard
    and bucket and the last values of one shard at a time, so more rows and
    keys ask for more shards; the number stays with the checkpoint.
    Rows later than the watermark are left out and counted (``late_rows``);
    rows without a time are left out.
    Rows of the last buckets stay in the state until a later row of any key
    moves the watermark on: a closing row in the far future ends all series.
    Start it by ``write_append``, which sets the state store that it needs. The
    key is of a type that a string can hold.
    Returns ``key, pos, x, target``.
    """
    if seq_len < 1 or look_ahead < 0 or shards < 1:
        raise ValueError("seq_len and shards must be at least 1 and look_ahead not negative")
    spark = stream.sparkSession
    width = _millis(spark, bucket) if bucket else max(1000, 8 * _millis(spark, delay))
    # keys are told apart as strings; a null one is the empty string
    text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    rows = stream.select(
        F.pmod(F.xxhash64(text), F.lit(shards)).cast("int").alias("shard"),
        text.alias("key"),
        F.col(time).cast("timestamp").alias("at"),
        F.unix_micros(F.col(time).cast("timestamp")).alias("micros"),
        (F.col(tie).cast("long") if tie else F.lit(0).cast("long")).alias("tie"),
        F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"),
        F.col(value).isNull().alias("gone"),
    ).where(F.col(time).isNotNull()).withWatermark("at", delay)
    columns = "key STRING, pos LONG, x ARRAY<DOUBLE>, x_code ARRAY<TINYINT>, target DOUBLE, target_code TINYINT"
    output = T.StructType.fromDDL(columns)
    out = rows.groupBy("shard").transformWithStateInPandas(
        _Lookahead(seq_len, look_ahead, width, output), output, "Append", "EventTime"
    )

    def told(value: Column, code: Column) -> Column:
        return F.when(code == 0, value).when(code == 2, F.lit(float("nan")))

    frame = F.when(F.col("x_code").isNull(), F.col("x")).otherwise(F.zip_with("x", "x_code", told))
    return out.select(
        F.when(F.col("key") != "", F.substr("key", F.lit(2))).cast(stream.schema[key].dataType).alias(key), "pos", frame.alias("x"), told(F.col("target"), F.col("target_code")).alias("target")
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query left out because they came behind its watermark."""
    return sum(
        op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"]
    )


def write_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-mode files; state is kept in RocksDB."""
    with rocksdb(stream.sparkSession):
        return (
            stream.writeStream.outputMode("append")
            .format("parquet")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(path)
        )


def write_fan_out(
    stream: DataFrame, sinks: Sequence[Callable[[DataFrame, int], None]], checkpoint: str
) -> StreamingQuery:
    """Each micro-batch to several sinks, read from the source once.

    Sinks get the batch id and should overwrite what they wrote for it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for sink in sinks:
                sink(kept, batch_id)
        finally:
            kept.unpersist()

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
