"""Every registered query against its SQL twin, and the shapes of key plans."""

from __future__ import annotations

import importlib.util
import pathlib
import re

import duckdb
import pytest

from stridemill.operators import order
from stridemill.plans import QUERIES, SQL

ROOT = pathlib.Path(__file__).resolve().parent.parent
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    frame = QUERIES[name](spark, data)
    columns = sorted(frame.columns)
    mine = frame.select(columns).toArrow()
    assert mine.num_rows > 0
    if name not in SQL:
        return
    theirs = duck.sql(SQL[name]).to_arrow_table().select(columns)
    kinds = [[str(f.type).replace("large_", "") for f in t.schema] for t in (mine, theirs)]
    assert kinds[0] == kinds[1]
    rows = [sorted(repr(tuple(r.values())) for r in t.to_pylist()) for t in (mine, theirs)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", ["lookahead_windows", "slide_windows_stride", "ordered_split_keyed", "progress", "fixed_cut_windows",
                                  "column_max_normalise"])
def test_query_with_hot_keys(spark, duck, data, name, monkeypatch):
    """The same rows when almost every key is too large for one task."""
    monkeypatch.setattr(order, "GROUP_ROWS", 3)
    monkeypatch.setattr(order, "CHUNK_ROWS", 11)
    monkeypatch.setattr(order, "ARRAY_ROWS", 7)
    test_query(spark, duck, data, name)


def entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_entry(spark):
    module = entry_module()
    assert module.entry(spark).count() == 5
    assert set(module.oracle_sql()) <= set(module.queries())


# --- plans ------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["naive_forecast_errors", "mse_state_merge", "confusion_normalised", "class_mapping",
                                  "ordered_split", "batches_drop_last", "minmax_scale", "cumulative_metric"])
def test_no_cross_joins(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_keyed_windows_shuffle_once_and_read_needed_columns(spark, data):
    text = plan(QUERIES["lookahead_windows"](spark, data))
    assert text.count("Exchange hashpartitioning") == 1
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "props" not in schema and "event_type" not in schema


def test_tumbling_windows_reuse_the_key_partitioning(spark, data):
    text = plan(QUERIES["slide_windows_stride"](spark, data))
    assert text.count("Exchange hashpartitioning") == 1


def test_random_split_does_not_move_rows(spark, data):
    assert "Exchange" not in plan(QUERIES["random_split_exact"](spark, data))


def test_ordered_split_does_not_move_rows(spark, data):
    text = plan(QUERIES["ordered_split"](spark, data))
    main = text.split("Subquery")[0]
    assert "Exchange hashpartitioning" not in main and "rangepartitioning" not in main


def test_metrics_combine_before_the_shuffle(spark, data):
    text = plan(QUERIES["r2_by_group"](spark, data))
    assert "partial_covar_pop" in text and text.count("Exchange hashpartitioning") == 1


def test_scaling_is_a_projection(spark, data):
    assert "Exchange" not in plan(QUERIES["minmax_scale"](spark, data))
    assert "Exchange" not in plan(QUERIES["standardize_columns"](spark, data))


def test_epoch_means_read_the_table_once(spark, data):
    assert plan(QUERIES["batch_epoch_loss"](spark, data)).count("FileScan") == 1


def test_global_position_needs_no_single_task(spark, data):
    text = plan(QUERIES["global_positions"](spark, data))
    assert "SinglePartition" not in text and "Window" not in text
