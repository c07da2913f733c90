"""Sources and sinks on small files written here."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from stridemill import session
from stridemill.sources import files, idx, sinks, text


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- session --------------------------------------------------------------------


def test_shared_dir_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_shared_dir_is_required_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    Context.master = "local[2]"
    assert session.shared_dir(Session()) == session.shared_dir(Session())


def test_stage_keeps_schema_and_rows(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "a INT, b ARRAY<DOUBLE>")
    staged = session.stage(df)
    assert staged.dtypes == df.dtypes and rows(staged, "a") == [(1,), (2,)]


# --- labelled series --------------------------------------------------------------


@pytest.fixture
def labelled_root(tmp_path):
    folder = tmp_path / "ECG"
    folder.mkdir()
    (folder / "ECG_TRAIN").write_text("1,0.5,1.5\n2, 2.5,3.5\n\n")
    (folder / "ECG_TEST").write_text("1,4.5,5.5\n3,6.5,7.5\n3,8.5,9.5\n")
    return str(tmp_path)


def test_labelled_csv_drops_the_last_test_row(spark, labelled_root):
    out = rows(text.labelled_csv(spark, labelled_root, "ECG"), "split", "label", "series")
    assert out == [
        ("test", 1.0, [4.5, 5.5]), ("test", 3.0, [6.5, 7.5]), ("train", 1.0, [0.5, 1.5]), ("train", 2.0, [2.5, 3.5])
    ]
    assert text.labelled_csv(spark, labelled_root, "ECG", drop_last_test_row=False).count() == 5


def test_last_row_of_a_file_in_many_splits(spark, tmp_path):
    folder = tmp_path / "Long"
    folder.mkdir()
    (folder / "Long_TRAIN").write_text("0,0\n")
    (folder / "Long_TEST").write_text("".join(f"{i},1.25,2.5\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        out = text.labelled_csv(spark, str(tmp_path), "Long").where("split = 'test'")
        assert out.rdd.getNumPartitions() > 3
        assert out.agg(F.count("*"), F.max("label")).first() == (4999, 4998.0)
        lines = text.read_lines(spark, str(folder / "Long_TEST")).orderBy(*text.LINE_ORDER).collect()
        assert [int(r["value"].split(",")[0]) for r in lines] == list(range(5000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.fixture
def archive_root(tmp_path):
    folder = tmp_path / "Multivariate" / "Two"
    folder.mkdir(parents=True)
    head = "# about\n@problemName Two\n@timeStamps false\n@classLabel true a b\n@data\n"
    (folder / "Two_TRAIN.ts").write_text(head + "1,2,3:4,5,6:a\n7,?,9:1,1,1:b\n")
    (folder / "Two_TEST.ts").write_text(head + "0,0:1,1: a \n")
    return str(tmp_path)


def test_ts_archive(spark, archive_root):
    out = {(r["split"], r["label"]): r["series"] for r in text.ts_archive(spark, archive_root, "Multivariate", "Two").collect()}
    assert out["train", "a"] == [[1, 4], [2, 5], [3, 6]]
    assert out["test", "a"] == [[0, 1], [0, 1]]
    assert math.isnan(out["train", "b"][1][0]) and out["train", "b"][1][1] == 1


@pytest.mark.parametrize("content", ["@timeStamps true\n@data\n1,2:a\n", "@data\n(0,1),(1,2):a\n"])
def test_time_stamped_series_are_refused(spark, archive_root, content):
    path = f"{archive_root}/Multivariate/Two/Two_TEST.ts"
    with open(path, "w") as out:
        out.write(content)
    with pytest.raises(Exception, match="time stamps"):
        text.ts_archive(spark, archive_root, "Multivariate", "Two").collect()


def test_unequal_channels_are_an_error(spark, archive_root):
    with open(f"{archive_root}/Multivariate/Two/Two_TEST.ts", "a") as out:
        out.write("1,2:3:a\n")
    with pytest.raises(Exception, match="differ in length"):
        text.ts_archive(spark, archive_root, "Multivariate", "Two").collect()


def test_series_csv(spark, tmp_path):
    path = tmp_path / "flights.csv"
    path.write_text("year,month,passengers\n1949,Jan,112\n1949,Feb,118\n1949,Mar,132\n")
    assert rows(text.series_csv(spark, str(path), "passengers"), "pos", "value") == [(0, 112.0), (1, 118.0), (2, 132.0)]
    with pytest.raises(ValueError):
        text.series_csv(spark, str(path), "people")


# --- file trees -------------------------------------------------------------------


def test_class_folders_and_catalogue(spark, tmp_path):
    for name in ("train/bees/1.jpg", "train/ants/2.jpg", "train/ants/3.jpg", "val/bees/4.jpg"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"x")
    (tmp_path / "readme.txt").write_text("not a data set")
    out = files.class_folders(spark, str(tmp_path))
    assert rows(out, "split", "class", "class_ix") == [
        ("train", "ants", 0), ("train", "ants", 0), ("train", "bees", 1), ("val", "bees", 1)
    ]
    assert rows(files.archive_datasets(spark, str(tmp_path)), "dataset") == [("train",), ("val",)]
    plan = files.list_paths(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


# --- idx --------------------------------------------------------------------------


@pytest.fixture
def pictures(tmp_path):
    rng = np.random.default_rng(0)
    images = rng.integers(0, 256, (37, 3, 4))
    marks = rng.integers(0, 10, 37)
    (tmp_path / "images").write_bytes(idx.idx_bytes(images))
    (tmp_path / "labels").write_bytes(idx.idx_bytes(marks))
    return str(tmp_path), images, marks


def test_idx_images_and_labels(spark, pictures):
    folder, images, marks = pictures
    df = idx.read_idx(spark, f"{folder}/images", partition_bytes=60)  # five records per partition
    assert df.rdd.getNumPartitions() == 8
    out = df.orderBy("pos").collect()
    assert [r["pos"] for r in out] == list(range(37))
    assert np.array_equal(np.array([r["image"] for r in out]), images)
    zipped = idx.read_labelled_images(spark, f"{folder}/images", f"{folder}/labels").orderBy("pos").collect()
    assert [r["label"] for r in zipped] == list(marks)


def test_idx_folder_counts_on(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part-{i}").write_bytes(idx.idx_bytes(np.arange(4) + 4 * i))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    out = idx.read_idx(spark, str(tmp_path), "labels")
    assert rows(out, "pos", "label") == [(i, i) for i in range(12)]


def test_idx_positions_reach_the_source(spark, tmp_path):
    """Only the records asked for are read; everything else is left to Spark."""
    for i in range(5):
        (tmp_path / f"part-{i}").write_bytes(idx.idx_bytes(np.arange(10) + 10 * i))
    eq = lambda kind, v, at=("pos",): kind(at, v)
    for filters, want, left in (
        ([eq(idx.GreaterThanOrEqual, 7), eq(idx.LessThanOrEqual, 23)], range(7, 24), 0),
        ([eq(idx.GreaterThan, 7), eq(idx.LessThan, 23), idx.IsNotNull(("pos",))], range(8, 23), 0),
        ([eq(idx.EqualTo, 31)], [31], 0), ([eq(idx.EqualTo, 99)], [], 0), ([eq(idx.LessThan, 2), eq(idx.GreaterThan, 2)], [], 0),
        ([eq(idx.EqualTo, 3, ("label",)), eq(idx.LessThan, 4)], range(4), 1), ([eq(idx.LessThan, 3.5)], range(50), 1),
    ):
        reader = idx.IdxReader(str(tmp_path), "labels", 4)
        assert len(list(reader.pushFilters(filters))) == left
        parts = reader.partitions()
        assert sorted(p.base + k for p in parts for k in range(p.first, p.last)) == list(want)
        assert [v for p in parts for b in reader.read(p) for v in b.column("pos").to_pylist()] == list(want)
    df = idx.read_idx(spark, str(tmp_path), "labels")
    some = df.where("pos BETWEEN 7 AND 23 AND label % 2 = 0")
    assert sorted((r["pos"], r["label"]) for r in some.collect()) == [(k, k) for k in range(8, 24, 2)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "label" in plan.split("Filter")[1] and "pos" not in plan.split("Filter")[1].split("BatchScan")[0].split("+-")[0]


def test_idx_headers_are_read_once_for_each_state_of_the_files(spark, tmp_path, monkeypatch):
    (tmp_path / "part-0").write_bytes(idx.idx_bytes(np.arange(4)))
    calls, real = [], idx.locate
    monkeypatch.setattr(idx, "locate", lambda *a: calls.append(a) or real(*a))
    monkeypatch.setattr(idx.Header, "read", staticmethod(lambda *a: pytest.fail("a header was read on the driver")))
    for _ in range(2):
        assert idx.read_idx(spark, str(tmp_path), "labels").count() == 4
    assert len(calls) == 1
    (tmp_path / "part-1").write_bytes(idx.idx_bytes(np.arange(3)))
    assert idx.read_idx(spark, str(tmp_path), "labels").count() == 7 and len(calls) == 2


def test_idx_of_nothing(spark, tmp_path):
    (tmp_path / "labels").write_bytes(idx.idx_bytes(np.zeros(0)))
    assert idx.read_idx(spark, str(tmp_path / "labels"), "labels").count() == 0


def test_idx_refuses_bad_files(spark, pictures):
    folder, images, _ = pictures
    with pytest.raises(Exception, match="magic 2049, expected 2051"):
        idx.read_idx(spark, f"{folder}/labels", "images").collect()
    with open(f"{folder}/cut", "wb") as out:
        out.write(idx.idx_bytes(images)[:-1])
    with pytest.raises(Exception, match="do not hold 37 records"):
        idx.read_idx(spark, f"{folder}/cut").collect()
    with pytest.raises(ValueError):
        idx.idx_bytes(np.zeros((2, 2)))


def test_convert_once(spark, pictures, tmp_path):
    folder, _, _ = pictures
    raw = {s: (f"{folder}/images", f"{folder}/labels") for s in ("training", "test")}
    target = str(tmp_path / "processed")
    first = idx.convert_once(spark, raw, target)
    assert first.groupBy("split").count().orderBy("split").collect() == [("test", 37), ("training", 37)]
    gone = {s: ("/nowhere/images", "/nowhere/labels") for s in raw}
    assert idx.convert_once(spark, gone, target).count() == 74  # the copy is used
    partly = {**raw, "extra": raw["test"]}
    assert idx.convert_once(spark, partly, target).count() == 111  # one split was missing


# --- sinks ------------------------------------------------------------------------


def test_metric_log_appends(spark, tmp_path):
    df = spark.createDataFrame(
        [("training", 1, "loss", 3.0), ("validation", 1, "loss", 4.0), ("training", 1, "acc", 0.5)],
        "phase STRING, epoch INT, metric STRING, value DOUBLE",
    )
    for i in range(2):
        sinks.append_metrics(df.withColumn("epoch", F.col("epoch") + i), ["loss", "acc"], str(tmp_path))
    out = sinks.read_metrics(spark, ["loss", "acc"], str(tmp_path))
    assert rows(out.where("acc IS NOT NULL"), "phase", "epoch", "loss", "acc") == [("training", 1, 3.0, 0.5), ("training", 2, 3.0, 0.5)]
    assert out.count() == 4
    logged = text.metric_log(spark, f"{tmp_path}/metric/phase=validation", "epoch INT, loss DOUBLE, acc DOUBLE")
    assert rows(logged, "epoch", "loss") == [(1, 4.0), (2, 4.0)]


def test_text_log(spark, tmp_path):
    df = spark.createDataFrame([("hello", 5, "x")], "text STRING, step INT, tag STRING").withColumn(
        "timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp")
    )
    sinks.append_text(df, str(tmp_path))
    sinks.append_text(df.select("text", "timestamp"), str(tmp_path))
    out = spark.read.schema("text STRING, timestamp TIMESTAMP, extra MAP<STRING,STRING>").json(f"{tmp_path}/text")
    assert sorted(len(r["extra"] or {}) for r in out.collect()) == [0, 2]


def test_predictions(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, "x")], "prediction DOUBLE, target DOUBLE, other STRING")
    default = sinks.write_predictions(df, str(tmp_path))
    chosen = sinks.write_predictions(df, str(tmp_path), str(tmp_path / "mine"))
    for path in (default, chosen):
        assert spark.read.option("header", True).csv(path).columns == ["prediction", "target"]


def test_an_existing_run_is_refused(spark, tmp_path):
    root = str(tmp_path / "run")
    sinks.write_parameters(spark, root, {"lr": 1}, {"lr": 2, "wd": 0})
    assert json.loads(spark.read.text(f"{root}/params").first()[0]) == {"lr": "2", "wd": "0"}
    with pytest.raises(AnalysisException):
        sinks.write_parameters(spark, root, {"lr": 1}, {})
    sinks.write_parameters(spark, root, {"lr": 1}, {}, project="debug")
    sinks.write_parameters(spark, root, {"lr": 3, "resume": True}, {})
    assert '"lr":"3"' in spark.read.text(f"{root}/params").first()[0]


def test_fan_out_computes_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for pdf in parts:
            seen.add(len(pdf))
            yield pdf

    df = spark.range(10).repartition(2).mapInPandas(count, "id LONG")
    sinks.fan_out(df, [lambda d: d.write.parquet(f"{tmp_path}/a"), lambda d: d.write.csv(f"{tmp_path}/b")])
    assert spark.read.parquet(f"{tmp_path}/a").count() == 10
    assert seen.value == 10


def test_convert_by_stem(spark, tmp_path):
    df = spark.createDataFrame([("in/a.tdms", 1), ("in/b.tdms", 2), ("in/a.tdms", 3)], "path STRING, v INT")
    sinks.convert_by_stem(df, "path", str(tmp_path / "out"))
    out = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert rows(out, "stem", "v") == [("a", "1"), ("a", "3"), ("b", "2")]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_ordered_predictions_from_any_position(spark, tmp_path, size):
    rows = [(float((i * 37) % 50), i % 3, i) for i in range(50)]
    df = spark.createDataFrame(rows, "prediction DOUBLE, target INT, i INT").repartition(6)
    path = sinks.write_predictions(df, str(tmp_path), order_by=["prediction"], file_rows=size)
    want = [(k, *r[:2]) for k, r in enumerate(sorted(rows))]
    schema = "prediction DOUBLE, target INT"
    got = sinks.read_predictions(spark, path, schema)
    assert got.columns == ["pos", "prediction", "target"] and sorted(map(tuple, got.collect())) == want
    for first, n in ((0, 1), (13, 20), (49, 5), (50, 3), (20, 0), (-4, 10)):
        part = sorted(map(tuple, sinks.read_predictions(spark, path, schema, first, n).collect()))
        low = max(0, first)
        assert part == want[low : first + n]
    # each file alone is in order, and only the wanted ones are read
    frame = sinks.read_predictions(spark, path, schema, 13, 3)
    assert "PartitionFilters: [isnotnull(block" in frame._jdf.queryExecution().executedPlan().toString()


def test_ordered_predictions_of_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "prediction DOUBLE, target INT")
    path = sinks.write_predictions(df, str(tmp_path), order_by="prediction")
    assert spark.read.schema(sinks.MANIFEST).json(f"{path}/_manifest").first()["n_rows"] == 0
