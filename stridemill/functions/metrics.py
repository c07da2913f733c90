"""Metrics as mergeable aggregate states.

A metric is a set of state columns over rows, a way to merge states of parts,
and a final expression. All states are partial aggregates, so grouping by a key
that holds most of the rows costs no more than by an even one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemill.functions.arrays import argmax
from stridemill.operators.joins import join_back
from stridemill.schema import ColumnLike, col, names

State = dict[str, Column]


def _sum_states(states: State, centres: State) -> State:
    return {s: F.sum(c) for s, c in states.items()}


@dataclass(frozen=True)
class Metric:
    """State columns over rows, their merge, and a final expression.

    In tables a state is called ``name__state``, so metrics never share or
    overwrite one. ``centre`` gives aggregates of the parts (pooled means) that
    ``merge`` may use as constants of the group.
    """

    name: str
    update: Callable[[Column, Column], State]
    finish: Callable[[State], Column]
    merge: Callable[[State, State], State] = _sum_states
    centre: Callable[[State], State] | None = None

    def column(self, state: str) -> str:
        return f"{self.name}__{state}"

    def read(self, states: Iterable[str]) -> State:
        return {s: F.col(f"`{self.column(s)}`") for s in states}


def mse() -> Metric:
    def update(yhat, y):
        d = (yhat - y).cast("double")
        return {"sse": F.sum(d * d), "nobs": F.count(d)}

    return Metric("mse", update, lambda s: F.try_divide(s["sse"], s["nobs"]))


def rmse(eps: float = 1e-6) -> Metric:
    base = mse()
    return Metric("rmse", base.update, lambda s: F.sqrt(base.finish(s) + eps))


def mae() -> Metric:
    def update(yhat, y):
        d = (yhat - y).cast("double")
        return {"sae": F.sum(F.abs(d)), "nobs": F.count(d)}

    return Metric("mae", update, lambda s: F.try_divide(s["sae"], s["nobs"]))


def mape(eps: float = 1e-6) -> Metric:
    """``eps`` keeps its sign: it is added to the target, not to its size."""

    def update(yhat, y):
        d = F.try_divide(yhat - y, y + F.lit(eps))
        return {"sape": F.sum(F.abs(d)), "nape": F.count(d)}

    return Metric("mape", update, lambda s: 100 * F.try_divide(s["sape"], s["nape"]))


def accuracy() -> Metric:
    """Prediction is an array of class scores, target a class index."""

    def update(yhat, y):
        hit = argmax(yhat) == y
        return {"hits": F.sum(hit.cast("long")), "nclass": F.count(hit)}

    return Metric("accuracy", update, lambda s: 100 * F.try_divide(s["hits"], s["nclass"]))


def accuracy_bar() -> Metric:
    def update(yhat, y):
        d = (yhat - y).cast("double")
        return {
            "sae": F.sum(F.abs(d)),
            "nobs": F.count(d),
            "sy": F.sum(y.cast("double")),
            "ny": F.count(y),
        }

    def finish(s):
        return 100 * (
            1 - F.try_divide(F.try_divide(s["sae"], s["nobs"]), F.try_divide(s["sy"], s["ny"]))
        )

    return Metric("accuracybar", update, finish)


def r2() -> Metric:
    """Squared Pearson correlation, from centred second moments.

    A constant column gives NULL. The state holds means, not sums: merging adds
    the distances of the part means from the pooled mean, so large means cost
    no digits.
    """

    def update(yhat, y):
        both = yhat.isNotNull() & y.isNotNull()
        p, t = F.when(both, yhat.cast("double")), F.when(both, y.cast("double"))
        n = F.count(p)
        return {
            "np": n,
            "mp": F.avg(p),
            "mt": F.avg(t),
            "mpp": F.var_pop(p) * n,
            "mtt": F.var_pop(t) * n,
            "mpt": F.covar_pop(p, t) * n,
        }

    def pooled(s: State, m: str) -> Column:
        return F.try_divide(F.sum(s["np"] * s[m]), F.sum(s["np"]))

    def centre(s):
        return {"mp": pooled(s, "mp"), "mt": pooled(s, "mt")}

    def merge(s, c):
        def centred(moment: str, a: str, b: str) -> Column:
            between = F.sum(s["np"] * (s[a] - c[a]) * (s[b] - c[b]))
            return F.sum(s[moment]) + F.coalesce(between, F.lit(0.0))

        return {
            "np": F.sum(s["np"]),
            "mp": F.first(c["mp"], ignorenulls=True) + F.coalesce(pooled({**s, "d": s["mp"] - c["mp"]}, "d"), F.lit(0.0)),
            "mt": F.first(c["mt"], ignorenulls=True) + F.coalesce(pooled({**s, "d": s["mt"] - c["mt"]}, "d"), F.lit(0.0)),
            "mpp": centred("mpp", "mp", "mp"),
            "mtt": centred("mtt", "mt", "mt"),
            "mpt": centred("mpt", "mp", "mt"),
        }

    def finish(s):
        return F.when(
            s["np"] > 1, F.try_divide(s["mpt"] * s["mpt"], s["mpp"] * s["mtt"])
        )

    return Metric("r2", update, finish, merge, centre)


BUILT_IN: dict[str, Callable[[], Metric]] = {
    "mse": mse,
    "rmse": rmse,
    "mae": mae,
    "mape": mape,
    "accuracy": accuracy,
    "accuracybar": accuracy_bar,
    "r2": r2,
}


def resolve(metrics: Iterable[str | Metric]) -> list[Metric]:
    """Names become built-in metrics; a ``Metric`` of the user's own is kept.

    Two metrics of one name are an error: their columns would be the same.
    """
    out = []
    for m in metrics:
        if isinstance(m, Metric):
            out.append(m)
        elif m in BUILT_IN:
            out.append(BUILT_IN[m]())
        else:
            raise ValueError(f"unknown metric {m!r}, expected one of {sorted(BUILT_IN)}")
    twice = {m.name for m in out if sum(o.name == m.name for o in out) > 1}
    if twice:
        raise ValueError(f"several metrics are called {sorted(twice)}")
    return out


def _states(metric: Metric) -> list[str]:
    return list(metric.update(F.lit(0.0), F.lit(0.0)))


def partial_states(
    df: DataFrame,
    metrics: Iterable[str | Metric],
    yhat: ColumnLike = "prediction",
    y: ColumnLike = "target",
    by: str | list[str] = (),
) -> DataFrame:
    """One row of state columns per group, in one pass over the rows."""
    columns = [
        c.alias(m.column(s)) for m in resolve(metrics) for s, c in m.update(col(yhat), col(y)).items()
    ]
    return df.groupBy(*names(by)).agg(*columns)


def merge_states(
    df: DataFrame, metrics: Iterable[str | Metric], by: str | list[str] = ()
) -> DataFrame:
    """Merge state rows into one row per (coarser) group.

    Metrics with a ``centre`` read the state rows (few, compared with the rows
    they stand for) twice.
    """
    keys, metrics = names(by), resolve(metrics)
    centres = [
        c.alias(f"__c_{m.column(s)}")
        for m in metrics if m.centre
        for s, c in m.centre(m.read(_states(m))).items()
    ]
    if centres and keys:
        df = join_back(df, df.groupBy(*keys).agg(*centres), keys)
    elif centres:
        row = df.agg(*centres).first()
        df = df.withColumns({name: F.lit(row[name]).cast("double") for name in row.asDict()})
    merged = []
    for m in metrics:
        about = {s: F.col(f"`__c_{m.column(s)}`") for s in m.centre(m.read(_states(m)))} if m.centre else {}
        merged += [c.alias(m.column(s)) for s, c in m.merge(m.read(_states(m)), about).items()]
    return df.groupBy(*keys).agg(*merged)


def finish_states(
    df: DataFrame, metrics: Iterable[str | Metric], keep: str | list[str] = ()
) -> DataFrame:
    return df.select(
        *[F.col(f"`{k}`") for k in names(keep)], *[m.finish(m.read(_states(m))).alias(m.name) for m in resolve(metrics)]
    )


def evaluate(
    df: DataFrame,
    metrics: Iterable[str | Metric],
    yhat: ColumnLike = "prediction",
    y: ColumnLike = "target",
    by: str | list[str] = (),
) -> DataFrame:
    """One column per metric and one row per group."""
    metrics = resolve(metrics)
    states = partial_states(df, metrics, yhat, y, by)
    return states.select(
        *names(by), *[m.finish(m.read(_states(m))).alias(m.name) for m in metrics]
    )


def explode_elements(df: DataFrame, yhat: str, y: str) -> DataFrame:
    """One row per element of array-valued predictions and targets.

    Arrays are counted per element by every metric but accuracy. Unequal length
    is an error.
    """
    same = F.size(yhat) == F.size(y)
    pairs = F.when(same, F.arrays_zip(F.col(yhat).alias("p"), F.col(y).alias("t"))).otherwise(
        F.raise_error(F.lit("prediction and target differ in length"))
    )
    others = [c for c in df.columns if c not in (yhat, y)]
    return df.select(*others, F.explode(pairs).alias("__e")).select(
        *others, F.col("__e.p").alias(yhat), F.col("__e.t").alias(y)
    )
