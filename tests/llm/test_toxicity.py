from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from stridemill.llm import queries, toxicity


def test_held_out_rule(spark):
    frame = spark.range(200).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.h for r in frame.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(200)}


def test_terms_are_lower_case_words_and_stems():
    rows, hashes, lower = toxicity._terms(pa.array(["Idiot! x", None, "idiotisch ÉTÉ"]))
    assert lower.to_pylist() == ["idiot! x", "", "idiotisch été"]
    words, stems4 = hashes[:4], hashes[4:7]  # of idiot, idiotisch, été
    assert list(rows[:4]) == [0, 0, 2, 2] and len(set(words.tolist())) == 4
    assert stems4[0] == stems4[1]  # both begin with idio


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(5)
    hidden = rng.random(4000) < 0.2
    fires = [np.where(hidden, rng.random(4000) < a, rng.random(4000) < b) for a, b in ((0.8, 0.02), (0.5, 0.01), (0.02, 0.02))]
    votes = np.stack([*fires, fires[0], fires[0]], 1).astype(float)
    noisy = np.where(rng.random(4000) < 0.03, ~hidden, hidden).astype(int)
    posterior, theta, discounts = toxicity.label_model(votes, noisy)
    assert abs(theta[1, 1] - 0.5) < 0.1 and theta[0, 1] < 0.05
    assert abs(theta[1, 2] - theta[0, 2]) < 0.05
    assert discounts[0] < 0.5 < discounts[1]
    assert ((posterior > 0.5) == hidden).mean() > 0.93


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_query_held_out_quality(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.QUERIES["op5_toxicity"](spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    both = got.merge(labels, on="doc_id").query("held_out")
    assert auc(both.score.to_numpy(), both.toxic.to_numpy()) > 0.95
    hit = both[both.toxic == 1].predicted.mean()
    false = both[both.toxic == 0].predicted.mean()
    assert hit > 0.85 and false < 0.01  # of the rows marked toxic, some 3 in 100 have no sign of it


def test_edges(spark):
    long = "fine words here " * 20_000
    rows = [(1, None, 0.5), (2, "", 1.0), (3, "You IDIOT, you pathetic loser!", 0.0), (4, long, 0.0), (4, long, 0.0), (None, "scum", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, score DOUBLE")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id LONG, toxic INT")
    model = toxicity.fit_on_labels(docs, labels)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "score"]
    by = {(r.doc_id, r.text): r.score for r in got.collect()}
    assert by[1, None] == by[2, ""] < 0.3 and by[3, rows[2][1]] > 0.9
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert sorted(r.doc_id for r in toxicity.drop_toxic(docs, labels).where("doc_id IS NOT NULL").collect()) == [1, 2, 4, 4]
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.fit_on_labels(empty, labels.limit(0))).count() == 0


def test_scores_do_not_depend_on_held_out_labels(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    from pyspark.sql import functions as F

    swapped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit_on_labels(docs, labels), toxicity.fit_on_labels(docs, swapped)
    assert (a.terms == b.terms).all() and np.allclose(a.weights, b.weights)


def test_models_are_equal_over_partitionings(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    models = [toxicity.fit_on_labels(d, labels) for d in (docs, docs.repartition(7), docs.repartition(3, "text"))]
    for m in models[1:]:
        assert np.array_equal(models[0].terms, m.terms) and np.array_equal(models[0].voter_of, m.voter_of)
        assert np.array_equal(models[0].weights, m.weights) and models[0].bias == m.bias


def test_unrelated_rows_that_share_a_line_all_count(spark):
    line = "copyright notice of the great northern library of plain works and letters "
    rows = [(i, line + " ".join(f"w{i}x{k}" for k in range(60)), int(i % 4 == 0)) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING, toxic INT")
    keyed = frame.select("text", "toxic").mapInArrow(toxicity._copy_keys, "text STRING, toxic INT, key1 LONG, key2 LONG")
    assert keyed.select("key1", "key2", "toxic").distinct().count() >= 36


def test_drop_toxic_keeps_a_column_of_its_own_name(spark):
    docs = spark.createDataFrame([(1, "fine words", "x")], "doc_id LONG, text STRING, `__toxic` STRING")
    out = toxicity.drop_toxic(docs, spark.createDataFrame([], "doc_id LONG, toxic INT"))
    assert [tuple(r) for r in out.collect()] == [(1, "fine words", "x")]
