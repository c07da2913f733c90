"""Stream results equal batch results, over several micro-batches."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from stridemill.functions.metrics import evaluate
from stridemill.operators.windows import lookahead_samples
from stridemill.plans import QUERIES
from stridemill.streaming import jobs
from stridemill.streaming.latest import LatestTable


def drop_files(spark, folder, parts, schema):
    """One parquet file per part, in modification order."""
    for i, part in enumerate(parts):
        path = f"{folder}/f{i}"
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet"):
                os.utime(f"{path}/{name}", (time.time() - 1000 + i, time.time() - 1000 + i))
    return f"{folder}/*"


SERIES = "k INT, ts TIMESTAMP, v DOUBLE"
BASE = 1_704_067_200


def timed(spark, rows):
    frame = spark.createDataFrame(rows, "k INT, s INT, v DOUBLE")
    return [tuple(r) for r in frame.select("k", F.timestamp_seconds(F.lit(BASE) + F.col("s")).alias("ts"), "v").collect()]


def run_lookahead(spark, tmp_path, parts, seq_len, look_ahead, delay):
    source = drop_files(spark, tmp_path / "in", [timed(spark, p) for p in parts], SERIES)
    stream = jobs.read_files(spark, source, SERIES, 1)
    samples = jobs.lookahead_samples(stream, "v", seq_len, look_ahead, "k", "ts", delay=delay)
    query = jobs.write_append(samples, f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("k", "pos", "x", "target").collect()
    return sorted(map(tuple, got), key=lambda r: (r[0] is not None, r[0] or 0, r[1])), query


def test_lookahead_out_of_order_over_micro_batches(spark, tmp_path):
    rows = [(k, t, None if t % 11 == 5 else float((t * 7 + (k or 5)) % 13)) for k, n in ((0, 50), (1, 9), (2, 23), (None, 7)) for t in range(n)]
    mixed = sorted(rows, key=lambda r: (r[1] * 17 + (r[0] or 0)) % 50)
    parts = [mixed[:30], mixed[30:31], mixed[31:60], mixed[60:], [(9, 100_000, 0.0)]]
    got, query = run_lookahead(spark, tmp_path, parts, 4, 2, "1 hour")
    assert query.lastProgress["batchId"] >= len(parts) - 1
    assert jobs.late_rows(query) == 0
    want = lookahead_samples(spark.createDataFrame(timed(spark, rows), SERIES), "v", 4, 2, "ts", "k")
    want = want.select("k", "pos", "x", "target").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(map(tuple, want), key=key)


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    parts = [[(0, t, float(t)) for t in (0, 1, 2, 30)], [(0, 31, 31.0)], [(0, 3, 99.0), (0, 32, 32.0)], [(0, 100, 0.0)]]
    got, query = run_lookahead(spark, tmp_path, parts, 2, 1, "5 seconds")
    assert [(r[1], r[2], r[3]) for r in got] == [(0, [0, 1], 2), (1, [1, 2], 30), (2, [2, 30], 31), (3, [30, 31], 32)]
    assert jobs.late_rows(query) == 1


@pytest.mark.parametrize("name", ["stream_running_mse", "stream_hopping", "stream_lookahead", "stream_multi_sink"])
def test_queries_run_over_several_micro_batches(spark, data, name, monkeypatch):
    seen = []
    for writer in ("write_latest", "write_append", "write_fan_out"):
        real = getattr(jobs, writer)
        monkeypatch.setattr(jobs, writer, lambda *a, real=real, **k: seen.append(real(*a, **k)) or seen[-1])
    QUERIES[name](spark, data)
    assert all(sum(p["numInputRows"] > 0 for p in q.recentProgress) >= 3 for q in seen) and seen
    assert all((jobs.late_rows(q) > 0) == (name in ("stream_hopping", "stream_lookahead")) for q in seen)


def test_samples_come_out_of_several_batches_and_state_is_removed(spark, data, monkeypatch):
    seen, real = [], jobs.write_append
    monkeypatch.setattr(jobs, "write_append", lambda s, path, check: seen.append((path, real(s, path, check))) or seen[-1][1])
    out = QUERIES["stream_lookahead"](spark, data)
    path, query = seen[0]
    sizes = []
    for name in os.listdir(f"{path}/_spark_metadata"):
        if name.isdigit():
            lines = open(f"{path}/_spark_metadata/{name}").read().split("\n")[1:]
            files = [json.loads(line)["path"] for line in lines]
            sizes.append(spark.read.schema(out.schema).parquet(*files).count() if files else 0)
    assert sum(n > 0 for n in sizes) >= 3
    # rows that wait never pile up: what is kept at the end is one tail for each key
    kept = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress]
    users = spark.read.parquet(f"{data}/events.parquet").select("user_id").distinct().count()
    assert kept[-1] < max(kept) and kept[-1] <= 3 * (users + 1)


def test_running_metric(spark, tmp_path):
    rows = [(f"r{i % 3}", float(i), float(i * i % 17)) for i in range(60)]
    schema = "run STRING, prediction DOUBLE, target DOUBLE"
    source = drop_files(spark, tmp_path / "in", [rows[:10], rows[10:11], rows[11:]], schema)
    states = jobs.running_metric_states(jobs.read_files(spark, source, schema, 1), ["mse", "mae"], by="run")
    jobs.write_latest(states, "run", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = {r["run"]: (r["mse"], r["mae"]) for r in jobs.read_latest(spark, f"{tmp_path}/out", ["mse", "mae"], "run").collect()}
    batch = evaluate(spark.createDataFrame(rows, schema), ["mse", "mae"], by="run").collect()
    assert got == {r["run"]: (pytest.approx(r["mse"]), pytest.approx(r["mae"])) for r in batch}


def test_hopping_slices_drop_rows_beyond_the_watermark(spark, tmp_path):
    schema = "ts TIMESTAMP, v DOUBLE"

    def at(*minutes):
        base = 1_704_067_200
        frame = spark.createDataFrame([(m, 1.0) for m in minutes], "m INT, v DOUBLE")
        return frame.select(F.timestamp_seconds(F.lit(base) + F.col("m") * 60).alias("ts"), "v").collect()

    source = drop_files(spark, tmp_path / "in", [at(1, 5, 12), at(65), at(66), at(2, 64, 70)], schema)
    stream = jobs.read_files(spark, source, schema, 1)
    slices = jobs.hopping_slices(stream, "ts", "v", "10 minutes", "5 minutes", "10 minutes")
    query = (
        slices.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/check")
        .trigger(availableNow=True).start(f"{tmp_path}/out")
    )
    query.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").select(
        ((F.unix_seconds("slice_start") - 1_704_067_200) / 60).cast("int").alias("m"), "n"
    )
    got = {r["m"]: r["n"] for r in out.collect()}
    assert {m: n for m, n in got.items() if m < 30} == {-5: 1, 0: 2, 5: 2, 10: 1}  # minute 2 came too late


def test_fan_out_sinks(spark, tmp_path):
    rows = [(i % 2, float(i)) for i in range(12)]
    source = drop_files(spark, tmp_path / "in", [rows[:4], rows[4:]], "g INT, v DOUBLE")
    jobs.write_fan_out(
        jobs.read_files(spark, source, "g INT, v DOUBLE", 1),
        [
            lambda df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/a/batch={i}"),
            lambda df, i: df.groupBy("g").count().write.mode("overwrite").json(f"{tmp_path}/b/batch={i}"),
        ],
        f"{tmp_path}/check",
    ).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/a").count() == 12
    assert spark.read.json(f"{tmp_path}/b").agg(F.sum("count")).first()[0] == 12


def test_lookahead_with_small_buckets_and_odd_values(spark, tmp_path):
    """NaN stays NaN and null stays null, whatever bucket and batch a row is in."""
    values = [1.0, None, float("nan"), 4.0, 5.0, None, 7.0, 8.0, 9.0, 10.0, 11.0, 12.0]
    rows = [(0, 7 * i, v) for i, v in enumerate(values)] + [(1, 3 * i, float(i)) for i in range(5)]
    parts = [rows[:4] + rows[12:], rows[4:9], rows[9:12], [(9, 100_000, 0.0)]]
    source = drop_files(spark, tmp_path / "in", [timed(spark, p) for p in parts], SERIES)
    stream = jobs.read_files(spark, source, SERIES, 1)
    samples = jobs.lookahead_samples(stream, "v", 3, 1, "k", "ts", delay="5 seconds", bucket="10 seconds")
    jobs.write_append(samples, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = sorted(str(tuple(r)) for r in spark.read.parquet(f"{tmp_path}/out").select("k", "pos", "x", "target").collect())
    batch = lookahead_samples(spark.createDataFrame(timed(spark, rows), SERIES), "v", 3, 1, "ts", "k")
    assert got == sorted(str(tuple(r)) for r in batch.select("k", "pos", "x", "target").collect())
    assert len(got) == 9 + 2


def _changes(spark, *rows):
    return spark.createDataFrame(rows, "k STRING, n LONG")


def test_latest_table_reads_few_files_however_many_batches(spark, tmp_path):
    table = LatestTable(spark, f"{tmp_path}/t", ["k"], deltas=3)
    want = {}
    for i in range(11):
        rows = [(f"k{j}", 100 * i + j) for j in range(i % 4 + 1)]
        want |= dict(rows)
        table.commit(_changes(spark, *rows), i)
        assert {r["k"]: r["n"] for r in LatestTable(spark, f"{tmp_path}/t", ["k"]).read().collect()} == want
    files = [f for f in os.listdir(f"{tmp_path}/t") if f.startswith(("delta", "snapshot"))]
    assert len(files) <= 2 * 4 and len(table.versions()) == 2
    assert len(table._content(table.versions()[-1])["files"]) <= 4


def test_latest_table_ignores_a_batch_run_again(spark, tmp_path):
    table = LatestTable(spark, f"{tmp_path}/t", ["k"], deltas=1)
    for i in range(3):
        table.commit(_changes(spark, ("a", i)), i)
    table.commit(_changes(spark, ("a", 99)), 1)
    table.commit(_changes(spark, ("a", 98)), 2)
    assert [tuple(r) for r in table.read().collect()] == [("a", 2)]
    # a batch that failed before it was published is written anew
    _changes(spark, ("a", 7), ("b", 7)).write.parquet(f"{tmp_path}/t/delta-3")
    assert [tuple(r) for r in table.read().collect()] == [("a", 2)]
    table.commit(_changes(spark, ("a", 3)), 3)
    assert [tuple(r) for r in table.read().collect()] == [("a", 3)]


def test_latest_table_with_null_keys_and_nothing(spark, tmp_path):
    table = LatestTable(spark, f"{tmp_path}/t", ["k"])
    with pytest.raises(FileNotFoundError):
        table.read()
    table.commit(_changes(spark, (None, 1), ("a", None)), 0)
    table.commit(_changes(spark, (None, 2)).where("n < 0"), 1)
    assert sorted(map(str, table.read().collect())) == sorted(map(str, _changes(spark, (None, 1), ("a", None)).collect()))


def test_lookahead_state_is_kept_for_shards_of_keys(spark, tmp_path):
    """State rows follow the shards and buckets, not the keys, of which there are far more here."""
    rows = [(k, 1000 * t + k % 700, None if (k + t) % 9 == 4 else float("nan") if (k + t) % 9 == 5 else float(k + t)) for k in range(2000) for t in range(4)]
    # rows without a time have no place in a series
    parts = [[r for r in rows if r[1] < 2000], [r for r in rows if r[1] >= 2000] + [(1, None, 1.0)], [(None, 10_000_000, 0.0)]]
    got, query = run_lookahead(spark, tmp_path, parts, 2, 1, "1 minute")
    assert jobs.late_rows(query) == 0
    want = lookahead_samples(spark.createDataFrame(timed(spark, rows), SERIES), "v", 2, 1, "ts", "k")
    assert len(got) == 4000 and sorted(map(str, got)) == sorted(map(str, map(tuple, want.select("k", "pos", "x", "target").collect())))
    kept = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress]
    assert max(kept) < 2000
