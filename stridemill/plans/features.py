"""Labels, scaling, array layout, projections and scoring over the driver tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.functions import arrays, losses
from stridemill.functions.arrays import array_sum, as_doubles
from stridemill.functions.losses import squared_error_sum
from stridemill.functions.scalars import drop_suffix, file_name, file_stem, merge_maps
from stridemill.operators import joins, labels, network, projection, scaling, scoring, transforms
from stridemill.plans.registry import query, rounded, table
from stridemill.session import fresh_path


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "label", as_doubles("embedding").alias("x"))


# --- labels -----------------------------------------------------------------


@query("""
WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS class_id
           FROM (SELECT DISTINCT p_brand FROM part WHERE p_size <= 25) b)
SELECT p_partkey, p_brand, class_id FROM part LEFT JOIN c USING (p_brand)
""")
def class_mapping(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select(
        "p_partkey", "p_brand", F.when(F.col("p_size") <= 25, "train").otherwise("test").alias("split")
    )
    return labels.encode_classes(part, "p_brand", handle_unseen="null").drop("split")


@query("""
SELECT p_partkey, p_size - (SELECT min(p_size) FROM part WHERE p_brand = 'Brand#7') AS p_size FROM part
""")
def zero_base_labels(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select(
        "p_partkey", "p_size", F.when(F.col("p_brand") == "Brand#7", "train").otherwise("test").alias("split")
    )
    return labels.zero_base_labels(part, "p_size").drop("split")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def class_counts(spark: SparkSession, folder: str) -> DataFrame:
    return labels.class_counts(table(spark, folder, "part"), "p_brand")


@query("""
SELECT count(DISTINCT label) AS n_classes, 4 AS min_channels, 4 AS max_channels, count(*) AS n_rows FROM embeddings
""")
def shape_summary(spark: SparkSession, folder: str) -> DataFrame:
    return labels.shape_summary(_stitched(spark, folder), "label", "series")


@query("SELECT s_suppkey, s_nationkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def dictionary_lookup(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    return joins.lookup(suppliers, names, "s_nationkey").select("s_suppkey", "s_nationkey", "n_name")


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_brand", "p_type").distinct()


@query("""
SELECT l_returnflag, round(sum(l_quantity + l_discount + l_tax), 4) AS total, round(sum(l_extendedprice), 2) AS label
FROM lineitem GROUP BY l_returnflag
""")
def feature_label_split(spark: SparkSession, folder: str) -> DataFrame:
    features, label = arrays.split_features(["l_quantity", "l_discount", "l_tax", "l_extendedprice"])
    rows = table(spark, folder, "lineitem").select("l_returnflag", features.alias("x"), label.alias("y"))
    return rows.groupBy("l_returnflag").agg(
        rounded(F.sum(array_sum("x")), 4).alias("total"), rounded(F.sum("y"), 2).alias("label")
    )


@query("""
SELECT 'data' AS target_kind, vec_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 6) + 0.0 AS target FROM embeddings
UNION ALL SELECT 'label', vec_id, label::DOUBLE FROM embeddings
""")
def self_and_label_targets(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _vectors(spark, folder)
    own = labels.as_samples(vectors.select("vec_id", "x"), "x").select(
        F.lit("data").alias("target_kind"), "vec_id", rounded(array_sum("target")).alias("target")
    )
    labelled = labels.as_samples(vectors, "x", "label").select(
        F.lit("label").alias("target_kind"), "vec_id", F.col("target").cast("double").alias("target")
    )
    return own.unionByName(labelled)


# --- scaling ----------------------------------------------------------------


@query("""
SELECT o_orderkey, round((o_totalprice - (SELECT min(o_totalprice) FROM orders))
       / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders), 9) AS scaled
FROM orders
""")
def minmax_scale(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    scaler = scaling.MinMax.fit(orders, "o_totalprice")
    return orders.select("o_orderkey", rounded(scaler.transform("o_totalprice"), 9).alias("scaled"))


@query("SELECT o_orderkey, round(o_totalprice, 3) AS restored FROM orders")
def minmax_inverse(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    scaler = scaling.MinMax.fit(orders, "o_totalprice")
    there_and_back = scaler.inverse(scaler.transform("o_totalprice"))
    return orders.select("o_orderkey", rounded(there_and_back, 3).alias("restored"))


@query("""
WITH f AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01')
SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 9) AS scaled FROM orders, f
""")
def minmax_fit_on_train(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    train = F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    scaler = scaling.MinMax.fit(orders, "o_totalprice", train)
    return orders.select("o_orderkey", rounded(scaler.transform("o_totalprice"), 9).alias("scaled"))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_samp({c}) FROM lineitem), 6) + 0.0 AS {c}"
        for c in _MEASURES
    )
    + " FROM lineitem"
)
def standardize_columns(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    scaler = scaling.Standard.fit(rows, _MEASURES)
    return rows.select(
        "l_orderkey", "l_linenumber", *[rounded(scaler.transform(c)).alias(c) for c in _MEASURES]
    )


@query("""
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
f AS (SELECT i, avg(v) AS m, stddev_samp(v) AS s FROM e GROUP BY i)
SELECT vec_id, i::INTEGER AS i, round((v - m) / s, 6) + 0.0 AS v FROM e JOIN f USING (i)
""")
def standardize_embedding(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _vectors(spark, folder)
    scaler = scaling.StandardArray.fit(vectors, "x")
    out = vectors.select("vec_id", F.posexplode(scaler.transform("x")).alias("i", "v"))
    return out.withColumn("v", rounded("v"))


@query("""
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT vec_id, i::INTEGER AS i, round((v - i / 256.0::DOUBLE) / (0.5 + i / 128.0::DOUBLE), 6) + 0.0 AS normal,
       round(least(greatest(v * (0.5 + i / 128.0::DOUBLE) + i / 256.0::DOUBLE, 0), 1), 6) + 0.0 AS clipped
FROM e
""")
def channel_normalise_clip(spark: SparkSession, folder: str) -> DataFrame:
    mean, std = [i / 256 for i in range(64)], [0.5 + i / 128 for i in range(64)]
    both = F.arrays_zip(
        scaling.channel_normalise("x", mean, std, max_pixel_value=1.0).alias("normal"),
        scaling.channel_denormalise_clip("x", mean, std).alias("clipped"),
    )
    out = _vectors(spark, folder).select("vec_id", F.posexplode(both).alias("i", "z"))
    return out.select(
        "vec_id", "i", rounded("z.normal").alias("normal"), rounded("z.clipped").alias("clipped")
    )


# --- array layout -----------------------------------------------------------


def _stitched(spark: SparkSession, folder: str) -> DataFrame:
    """Four channels of 16 steps per vector, stitched to 16 x 4."""
    channels = [F.slice("x", 16 * c + 1, 16) for c in range(4)]
    return _vectors(spark, folder).select("vec_id", "label", arrays.stitch_channels(*channels).alias("series"))


@query("""
SELECT vec_id, t::INTEGER AS t, embedding[t + 1]::DOUBLE AS ch0, embedding[t + 17]::DOUBLE AS ch1,
       embedding[t + 33]::DOUBLE AS ch2, embedding[t + 49]::DOUBLE AS ch3
FROM embeddings, generate_series(0, 15) s(t)
""")
def channel_stitch(spark: SparkSession, folder: str) -> DataFrame:
    steps = _stitched(spark, folder).select("vec_id", F.posexplode("series").alias("t", "row"))
    return steps.select("vec_id", "t", *[F.get("row", c).alias(f"ch{c}") for c in range(4)])


@query("""
SELECT vec_id, i::INTEGER AS i, embedding[(i % 8) * 8 + i // 8 + 1]::DOUBLE AS v
FROM embeddings, generate_series(0, 63) s(i)
""")
def transpose_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = F.array(*[F.slice("x", 8 * r + 1, 8) for r in range(8)])
    swapped = arrays.flatten(arrays.transpose("m"))
    return _vectors(spark, folder).select("vec_id", rows.alias("m")).select(
        "vec_id", F.posexplode(swapped).alias("i", "v")
    )


@query("""
SELECT vec_id, i::INTEGER AS i, embedding[i + 1]::DOUBLE AS v, 1 AS inner_size
FROM embeddings, generate_series(0, 63) s(i)
""")
def flatten_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Add axes at both ends, drop the leading one, flatten again."""
    boxed = _vectors(spark, folder).select("vec_id", arrays.unsqueeze(arrays.expand_dims("x")).alias("b"))
    opened = boxed.select("vec_id", arrays.squeeze("b").alias("m"))
    out = opened.select("vec_id", "m", F.posexplode(arrays.flatten("m")).alias("i", "v"))
    return out.select("vec_id", "i", "v", F.size(F.get("m", 0)).alias("inner_size"))


@query("""
SELECT event_id, regexp_extract(props, '"k": ([0-9]+)', 1) AS k, 'override' AS source, event_type AS kind FROM events
""")
def params_merge(spark: SparkSession, folder: str) -> DataFrame:
    base = F.map_concat(
        F.from_json("props", "map<string,string>"), F.create_map(F.lit("source"), F.lit("base"))
    )
    override = F.create_map(F.lit("source"), F.lit("override"), F.lit("kind"), F.col("event_type"))
    merged = table(spark, folder, "events").select("event_id", merge_maps(base, override).alias("p"))
    return merged.select("event_id", *[F.col("p")[k].alias(k) for k in ("k", "source", "kind")])


@query("""
WITH n AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages)
SELECT page_id, name, regexp_replace(name, '^(.+)\\.[^.]*$', '\\1') AS stem,
       CASE WHEN ends_with(name, '#top') THEN name[:-5] ELSE name END AS bare
FROM n
""")
def file_stems(spark: SparkSession, folder: str) -> DataFrame:
    name = file_name("url")
    return table(spark, folder, "pages").select(
        "page_id", name.alias("name"), file_stem("url").alias("stem"), drop_suffix(name, "#top").alias("bare")
    )


@query("""
SELECT event_id, greatest(value - 40, 0.0) AS relu, least(greatest(value, 10.0), 60.0) AS clamped,
       round(1 / (1 + exp(-(value - 40) / 10)), 9) AS sigmoid
FROM events
""")
def activations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id",
        arrays.relu(F.col("value") - 40).alias("relu"),
        arrays.clamp("value", 10, 60).alias("clamped"),
        rounded(arrays.sigmoid((F.col("value") - 40) / 10), 9).alias("sigmoid"),
    )


@query("""
SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: (v::DOUBLE - 0.5) * 2)), 6) + 0.0 AS total,
       label * 10 AS target
FROM embeddings
""")
def user_transforms(spark: SparkSession, folder: str) -> DataFrame:
    """A sample transform in numpy and a target transform as a column."""

    def rescale(values: pd.Series) -> pd.Series:
        whole = (np.stack(values.to_numpy()) - 0.5) * 2  # all rows of the batch at once
        return pd.Series(list(whole), index=values.index)

    out = transforms.apply_transforms(
        labels.as_samples(_vectors(spark, folder), "x", "label"),
        rescale, lambda c: c * 10, transform_type="array<double>",
    )
    return out.select("vec_id", rounded(array_sum("data")).alias("total"), "target")


# --- projections ------------------------------------------------------------


@query("""
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT a.i AS i, b.i AS j, round(covar_samp(a.v, b.v), 9) + 0.0 AS value
FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i
""")
def covariance_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return projection.covariance(_vectors(spark, folder), "x").withColumn("value", rounded("value", 9))


_SPREAD = """
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
f AS (SELECT i, avg(v) AS m FROM e GROUP BY i),
s AS (SELECT vec_id, label, sum(power(v - m, 2)) AS energy FROM e JOIN f USING (i) GROUP BY vec_id, label)
"""


@query(_SPREAD + """
SELECT vec_id, label, round(energy, 6) AS energy, 0.0::DOUBLE AS overlap, 0.0::DOUBLE AS order_faults FROM s
""")
def pca_project(spark: SparkSession, folder: str) -> DataFrame:
    """Three components: what they keep of a row and what they leave add up to its distance
    from the mean; the scores of the components are uncorrelated and fall in variance."""
    vectors = _vectors(spark, folder)
    model = projection.fit_pca(vectors, "x", 3)
    out = model.reconstruct(model.transform(vectors, "x"), "x", "back")
    facts = out.agg(
        *[F.corr(F.get("z", i), F.get("z", j)).alias(f"c{i}{j}") for i, j in ((0, 1), (0, 2), (1, 2))],
        *[F.var_samp(F.get("z", i)).alias(f"v{i}") for i in range(3)],
    ).first()
    overlap = max(abs(facts[c]) for c in ("c01", "c02", "c12"))
    faults = float(facts["v0"] < facts["v1"]) + float(facts["v1"] < facts["v2"])
    return out.select(
        "vec_id", "label",
        rounded(arrays.dot("z", "z") + squared_error_sum("x", "back")).alias("energy"),
        rounded(F.lit(overlap)).alias("overlap"), F.lit(faults).alias("order_faults"),
    )


@query(_SPREAD + """
SELECT label, round(avg(energy), 6) AS energy, true AS smaller FROM s GROUP BY label
""")
def pca_reconstruct_error(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen components: kept variance plus reconstruction error is the whole, per label,
    and sixteen leave a smaller error than three."""
    vectors = _vectors(spark, folder)
    model = projection.fit_pca(vectors, "x", 16)
    out = model.reconstruct(model.transform(vectors, "x"), "x", "back")
    out = projection.fit_pca(vectors, "x", 3).reconstruct(out, "x", "rough")
    error = squared_error_sum("x", "back")
    return out.groupBy("label").agg(
        rounded(F.avg(error + arrays.dot("z", "z"))).alias("energy"),
        (F.avg(error) < F.avg(squared_error_sum("x", "rough"))).alias("smaller"),
    )


@query("""
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT vec_id, round(sum(v * v), 6) AS energy, true AS orthonormal, true AS longest FROM e GROUP BY vec_id
""")
def svd_project(spark: SparkSession, folder: str) -> DataFrame:
    """Three right singular vectors: orthonormal, of the largest gain, and a row's scores and
    residual add up to its length."""
    vectors = _vectors(spark, folder)
    model = projection.fit_svd(vectors, "x", 3)
    v = model.components
    out = vectors.withColumn("z", model.transform("x"))
    back = scoring.dense([(v.T, np.zeros(v.shape[0]))], F.col("z"))
    out = out.withColumn("back", back)
    gains = out.agg(*[F.sum(F.get("z", i) * F.get("z", i)).alias(f"g{i}") for i in range(3)]).first()
    gains = np.array([gains[f"g{i}"] for i in range(3)])
    orthonormal = bool(np.abs(v.T @ v - np.eye(3)).max() < 1e-8)
    longest = bool(np.allclose(gains, model.singular_values**2) and (np.diff(gains) <= 1e-9).all())
    return out.select(
        "vec_id", rounded(arrays.dot("z", "z") + squared_error_sum("x", "back")).alias("energy"),
        F.lit(orthonormal).alias("orthonormal"), F.lit(longest).alias("longest"),
    )


@query("""
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
f AS (SELECT i, avg(v) AS m FROM e GROUP BY i)
SELECT vec_id, round(sum(power(v - m, 2)), 6) AS energy, 0.0::DOUBLE AS error FROM e JOIN f USING (i) GROUP BY vec_id
""")
def pca_full_rank(spark: SparkSession, folder: str) -> DataFrame:
    """All components: scores keep the distance to the mean, and rows come back."""
    vectors = _vectors(spark, folder)
    model = projection.fit_pca(vectors, "x", 64)
    out = model.transform(vectors, "x").withColumn("back", model.inverse("z"))
    return out.select(
        "vec_id",
        rounded(arrays.dot("z", "z")).alias("energy"),
        rounded(squared_error_sum("x", "back")).alias("error"),
    )


@query("""
SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)), 6) AS energy FROM embeddings
""")
def svd_full_rank(spark: SparkSession, folder: str) -> DataFrame:
    """All right singular vectors: scores keep the length of every row."""
    vectors = _vectors(spark, folder)
    out = vectors.withColumn("z", projection.fit_svd(vectors, "x", 64).transform("x"))
    return out.select("vec_id", rounded(arrays.dot("z", "z")).alias("energy"))


# --- scoring ----------------------------------------------------------------


def _rule_layers(widths: list[int]) -> scoring.Layers:
    """Small dyadic weights from a rule that SQL can state as well."""
    out = []
    for n, (rows, cols) in enumerate(zip(widths, widths[1:])):
        i, j = np.meshgrid(np.arange(rows), np.arange(cols), indexing="ij")
        out.append((((i * (n + 2) + j * 3 + n) % 5 - 2) / 8.0, (np.arange(cols) % 3 - 1) / 4.0))
    return out


def _rule_sql(widths: list[int], relu: list[bool]) -> str:
    steps = ["h0 AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"]
    for n, (cols, active) in enumerate(zip(widths[1:], relu)):
        total = f"sum(v * (((i * {n + 2} + j * 3 + {n}) % 5 - 2) / 8.0::DOUBLE)) + (j % 3 - 1) / 4.0::DOUBLE"
        value = f"greatest({total}, 0)" if active else total
        steps.append(
            f"h{n + 1} AS (SELECT vec_id, label, {value} AS v, j AS i FROM h{n}, generate_series(0, {cols - 1}) t(j) "
            "GROUP BY vec_id, label, j)"
        )
    return ", ".join(steps)


_HEAD = [64, 16, 10]
_AE = scoring.autoencoder_widths(64, 4)


@query(f"WITH {_rule_sql(_HEAD, [True, False])} SELECT vec_id, i::INTEGER AS i, round(v, 6) + 0.0 AS v FROM h2")
def dense_score(spark: SparkSession, folder: str) -> DataFrame:
    """Weights go through a stored weight table, as they would from a model file."""
    path = fresh_path(spark, "weights")
    scoring.write_weights(spark, _rule_layers(_HEAD), path)
    layers = scoring.load_weights(spark.read.parquet(path))
    out = _vectors(spark, folder).withColumn("s", scoring.dense(layers, "x"))
    return out.select("vec_id", F.posexplode("s").alias("i", "v")).withColumn("v", rounded("v"))


@query(f"WITH {_rule_sql(_AE[:4], [True, True, False])} SELECT vec_id, i::INTEGER AS i, round(v, 6) + 0.0 AS v FROM h3")
def encode_latent(spark: SparkSession, folder: str) -> DataFrame:
    out = _vectors(spark, folder).withColumn("s", scoring.encode(_rule_layers(_AE), "x"))
    return out.select("vec_id", F.posexplode("s").alias("i", "v")).withColumn("v", rounded("v"))


@query(f"""
WITH {_rule_sql(_AE, [True, True, False, True, True, False])}
SELECT a.vec_id, round(avg(power(a.v - b.v, 2)), 6) AS mse
FROM h6 a JOIN h0 b ON a.vec_id = b.vec_id AND a.i = b.i GROUP BY a.vec_id
""")
def autoencode_error(spark: SparkSession, folder: str) -> DataFrame:
    out = _vectors(spark, folder).withColumn("back", scoring.autoencode(_rule_layers(_AE), "x"))
    return out.select("vec_id", rounded(squared_error_sum("x", "back") / F.size("x")).alias("mse"))


@query(f"""
WITH {_rule_sql(_HEAD, [True, False])},
b AS (SELECT vec_id, label, arg_max(i, v) AS pred FROM h2 GROUP BY vec_id, label)
SELECT label, round(100.0 * avg((pred = label)::INTEGER), 6) AS accuracy FROM b GROUP BY label
""")
def score_report(spark: SparkSession, folder: str) -> DataFrame:
    scored = _vectors(spark, folder).withColumn("prediction", scoring.dense(_rule_layers(_HEAD), "x"))
    out = scoring.score_report(scored, ["accuracy"], "prediction", "label", "label")
    return out.withColumn("accuracy", rounded("accuracy"))


@query(f"""
WITH {_rule_sql(_HEAD, [True, False])}
SELECT vec_id, arg_max(i, v)::INTEGER AS prediction, label AS target FROM h2 GROUP BY vec_id, label
""")
def class_predictions(spark: SparkSession, folder: str) -> DataFrame:
    scored = _vectors(spark, folder).withColumn("s", scoring.dense(_rule_layers(_HEAD), "x"))
    return scoring.predictions(scored, "s", "label", keep=["vec_id"])


@query("""
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))), 6) AS norm,
       round(list_max(list_transform(embedding, lambda v: abs(v::DOUBLE))), 6) AS top
FROM embeddings
""")
def user_scorer(spark: SparkSession, folder: str) -> DataFrame:
    """A user's own model function, called on Arrow batches."""

    def load():
        def predict(x: np.ndarray) -> np.ndarray:
            return np.stack([np.sqrt((x * x).sum(axis=1)), np.abs(x).max(axis=1)], axis=1)

        return predict

    out = scoring.score_rows(_vectors(spark, folder), load, "x", 64)
    return out.select(
        "vec_id", rounded(F.get("prediction", 0)).alias("norm"), rounded(F.get("prediction", 1)).alias("top")
    )


def _training_sql(widths: list[int], rows: str, steps: int, rate: float, momentum: float) -> str:
    """Full-batch Nesterov steps from the rule's weights, and the loss of every row after them.

    ``rows`` names a table ``vec_id, label, i, v``. Weights live in
    ``w{layer}_{step} (i, j, w)`` with the bias as row -1, speeds in ``s...``.
    """
    n, out = len(widths) - 1, []
    for k, (r, c) in enumerate(zip(widths, widths[1:])):
        rule = f"((i * {k + 2} + j * 3 + {k}) % 5 - 2) / 8.0::DOUBLE"
        out.append(
            f"w{k}_0 AS (SELECT i, j, CASE WHEN i < 0 THEN (j % 3 - 1) / 4.0::DOUBLE ELSE {rule} END AS w, 0::DOUBLE AS s "
            f"FROM generate_series(-1, {r - 1}) t(i), generate_series(0, {c - 1}) u(j))"
        )

    def forward(step: str, weight: str) -> None:
        for k in range(n):
            source = rows if k == 0 else f"a{k}_{step}"
            out.append(
                f"z{k + 1}_{step} AS (SELECT x.vec_id, x.label, w.j, sum(x.v * {weight}) AS z FROM "
                f"(SELECT vec_id, label, i, v FROM {source} UNION ALL SELECT DISTINCT vec_id, label, -1, 1::DOUBLE FROM {rows}) x "
                f"JOIN w{k}_{step} w ON w.i = x.i GROUP BY x.vec_id, x.label, w.j)"
            )
            out.append(f"a{k + 1}_{step} AS (SELECT vec_id, label, j AS i, greatest(z, 0) AS v FROM z{k + 1}_{step})")
        out.append(
            f"p_{step} AS (SELECT vec_id, label, j, z, exp(z - max(z) OVER q) / sum(exp(z)) OVER q * exp(max(z) OVER q) AS p "
            f"FROM z{n}_{step} WINDOW q AS (PARTITION BY vec_id))"
        )

    for t in range(steps):
        ahead = f"(w.w + {momentum}::DOUBLE * w.s)"
        forward(str(t), ahead)
        out.append(
            f"d{n}_{t} AS (SELECT vec_id, label, j, (p - (j = label)::INTEGER) / count(*) OVER (PARTITION BY j) AS d FROM p_{t})"
        )
        for k in reversed(range(n)):
            source = rows if k == 0 else f"a{k}_{t}"
            out.append(
                f"g{k}_{t} AS (SELECT x.i, d.j, sum(x.v * d.d) AS g FROM (SELECT vec_id, i, v FROM {source} "
                f"UNION ALL SELECT DISTINCT vec_id, -1, 1::DOUBLE FROM {rows}) x JOIN d{k + 1}_{t} d USING (vec_id) GROUP BY x.i, d.j)"
            )
            if k:
                out.append(
                    f"d{k}_{t} AS (SELECT d.vec_id, d.label, w.i AS j, sum(d.d * {ahead}) * any_value((a.v > 0)::INTEGER) AS d "
                    f"FROM d{k + 1}_{t} d JOIN w{k}_{t} w ON w.j = d.j AND w.i >= 0 JOIN a{k}_{t} a ON a.vec_id = d.vec_id AND a.i = w.i "
                    "GROUP BY d.vec_id, d.label, w.i)"
                )
        for k in range(n):
            speed = f"{momentum}::DOUBLE * w.s - {rate}::DOUBLE * g.g"
            out.append(
                f"w{k}_{t + 1} AS (SELECT w.i, w.j, w.w + {speed} AS w, {speed} AS s FROM w{k}_{t} w JOIN g{k}_{t} g USING (i, j))"
            )
    forward(str(steps), "w.w")
    return ", ".join(out)


_AFTER = """
, r AS (SELECT vec_id, label, -ln(max(p) FILTER (j = label)) AS loss, arg_max(j, z) AS best FROM p_{0} GROUP BY vec_id, label)
SELECT label, count(*) AS n, round(avg(loss), 6) AS loss, count(*) FILTER (best = label) AS hits FROM r GROUP BY label
"""
_FEATURES = "f AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
_NET, _SMALL_NET = [64, 8, 8, 10], [4, 8, 8, 10]


def _after(model: network.Classifier, df: DataFrame, x: str) -> DataFrame:
    """Rows, mean cross-entropy and right answers of each class."""
    scored = df.withColumn("scores", scoring.dense(model.layers, x))
    scored = scored.select(
        "label", losses.cross_entropy("scores", "label").alias("loss"), (arrays.argmax("scores") == F.col("label")).alias("hit")
    )
    return scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("loss")).alias("loss"), F.count_if("hit").alias("hits")
    )


@query(f"WITH {_FEATURES}, {_training_sql(_NET, 'f', 1, 0.5, 0.0)}{_AFTER.format(1)}")
def classifier_step(spark: SparkSession, folder: str) -> DataFrame:
    """Loss per class of fixed weights after one step down the gradient of all rows."""
    vectors = _vectors(spark, folder)
    model = network.train(vectors, "x", "label", _rule_layers(_NET), 1, "nesterov", 0.5, 0.0)
    return _after(model, vectors, "x")


@query(f"WITH {_FEATURES}, {_training_sql(_NET, 'f', 3, 0.2, 0.9)}{_AFTER.format(3)}")
def mlp_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Loss and right answers per class after three Nesterov steps over all rows."""
    vectors = _vectors(spark, folder)
    model = network.train(vectors, "x", "label", _rule_layers(_NET), 3, "nesterov", 0.2, 0.9)
    return _after(model, vectors, "x")


@query(f"""
WITH {_rule_sql(_AE[:4], [True, True, False])}, f AS (SELECT vec_id, label, i, v FROM h3),
{_training_sql(_SMALL_NET, 'f', 2, 0.1, 0.9)}{_AFTER.format(2)}""")
def compress_then_classify(spark: SparkSession, folder: str) -> DataFrame:
    """A classifier fitted for two steps on the latents of a given encoder."""
    latents = _vectors(spark, folder).select("label", scoring.encode(_rule_layers(_AE), "x").alias("z"))
    model = network.train(latents, "z", "label", _rule_layers(_SMALL_NET), 2, "nesterov", 0.1, 0.9)
    return _after(model, latents, "z")


_NOISE = """
n AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS m, embedding[i + 33]::DOUBLE AS v,
             md5(concat_ws(':', md5(concat_ws(':', vec_id, 11)), i)) AS h
      FROM embeddings, generate_series(0, 31) t(i)),
u AS (SELECT *, (CAST('0x' || substr(h, 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u1,
             (CAST('0x' || substr(h, 17, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u2 FROM n)
"""


@query(f"""
WITH {_NOISE}
SELECT vec_id, i::INTEGER AS i, round(m + sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) * exp(v / 2), 6) + 0.0 AS z FROM u
""")
def latent_sample(spark: SparkSession, folder: str) -> DataFrame:
    halves = _vectors(spark, folder).select(
        "vec_id", F.slice("x", 1, 32).alias("mean"), F.slice("x", 33, 32).alias("logvar")
    )
    z = scoring.latent_sample("mean", "logvar", ["vec_id"], seed=11)
    return halves.select("vec_id", F.posexplode(z).alias("i", "z")).withColumn("z", rounded("z"))


@query("""
SELECT vec_id, i::INTEGER AS i, embedding[i + 1]::DOUBLE AS z FROM embeddings, generate_series(0, 31) t(i)
""")
def latent_mean(spark: SparkSession, folder: str) -> DataFrame:
    halves = _vectors(spark, folder).select(
        "vec_id", F.slice("x", 1, 32).alias("mean"), F.slice("x", 33, 32).alias("logvar")
    )
    z = scoring.latent_sample("mean", "logvar", ["vec_id"], training=False)
    return halves.select("vec_id", F.posexplode(z).alias("i", "z"))
