"""Slice summaries on any grid against the slices' edges, row by row."""

from __future__ import annotations

import math
import random

import pytest

from stridemill.operators.windows import SliceGrid, assign_slices, slice_summary


def brute(rows, grid):
    out = {}
    for k in range(grid.count):
        start = grid.t0 + k * grid.stride
        mine = [v for t, v in rows if t is not None and not math.isnan(t) and start <= t < start + grid.length]
        if mine:
            known = [v for v in mine if v is not None]
            out[k] = (len(mine), math.fsum(known) if known else None, min(known, default=None), max(known, default=None))
    return out


GRIDS = [
    (0.0, 0.3, 0.1, 60), (0.0, 0.3, 0.1, 9), (1.7, 0.7, 0.0125, 300), (-2.0, 1.0, 1.0, 12), (0.1, 0.1, 0.1, 70), (0.0, 0.25, 0.5, 14),
    (0.3, 0.2, 0.1, 1), (0.0, 5.0, 0.01, 40), (2.0, 1e-3, 0.7, 9), (0.0, 0.4, 0.2, 33), (0.0, 1.0, 0.3, 21), (-1.0, 100.0, 0.5, 8),
    (0.0, 0.3, 0.1, 0),
]


@pytest.mark.parametrize("spec", GRIDS)
def test_fractional_grids(spark, spec):
    grid = SliceGrid(*spec)
    rng = random.Random(str(spec))
    times = [rng.uniform(-1, 7) for _ in range(150)]
    edges = [grid.t0 + k * grid.stride for k in range(grid.count)]
    times += rng.sample(edges, min(40, len(edges))) + [e + grid.length for e in rng.sample(edges, min(40, len(edges)))]
    times += [math.nextafter(e, d) for e in edges[:10] for d in (-math.inf, math.inf)] + [None, float("nan"), -1e9, 1e9]
    rows = [(t, None if i % 17 == 3 else float(i * 37 % 101)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "t DOUBLE, v DOUBLE")
    got = {r["slice"]: tuple(r[c] for c in ("n", "total", "low", "high")) for r in slice_summary(df, "t", "v", grid).collect()}
    assert got == brute(rows, grid)
    assert {k: r[0] for k, r in got.items()} == {
        r["slice"]: r["count"] for r in assign_slices(df.where("t IS NOT NULL AND t = t AND NOT isnan(t)"), "t", grid).groupBy("slice").count().collect()
    }


@pytest.mark.parametrize("spec", [(0, 60, 30, 40), (5, 7, 3, 100), (0, 10, 25, 30), (-20, 100, 1, 300)])
def test_whole_grids(spark, spec):
    grid = SliceGrid(*spec)
    rng = random.Random(str(spec))
    rows = [(rng.randint(-50, 700), float(rng.randint(0, 99))) for _ in range(400)]
    df = spark.createDataFrame(rows, "t LONG, v DOUBLE")
    got = {r["slice"]: tuple(r[c] for c in ("n", "total", "low", "high")) for r in slice_summary(df, "t", "v", grid).collect()}
    assert got == brute(rows, grid)


def test_rows_are_folded_once_and_not_copied(spark):
    """Each row lies in 500 slices; the rows behind the first exchange are intervals, not rows."""
    grid = SliceGrid(0.0, 5.0, 0.01, 1000)
    df = spark.range(20_000).selectExpr("CAST(id % 1000 AS DOUBLE) / 100 AS t", "1.0D AS v")
    out = slice_summary(df, "t", "v", grid)
    assert out.count() == 1000
    plan = out._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.rindex("Generate") :]
    assert "partial_count" in scan and "explode" not in scan[10:].split("Range")[-1]
    assert plan.count("Generate") == 2
