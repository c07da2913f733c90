"""Windows, splits, samples and batches over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.functions.arrays import array_sum
from stridemill.functions.metrics import evaluate
from stridemill.functions.scalars import bin_label
from stridemill.operators import order as ordered
from stridemill.operators import sampling, splits, windows
from stridemill.plans.registry import micros, query, rounded, table

EVENT_ORDER = ["ts", "event_id"]
HOUR = 3_600_000_000


@query("""
SELECT user_id, row_number() OVER w - 1 AS pos, value AS x0, lead(value, 1) OVER w AS x1,
       lead(value, 2) OVER w AS x2, lead(value, 3) OVER w AS x3,
       lead(value, 4) OVER w AS target, lead(event_id, 4) OVER w AS event_id
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
QUALIFY lead(event_id, 4) OVER w IS NOT NULL
""")
def lookahead_windows(spark: SparkSession, folder: str) -> DataFrame:
    samples = windows.lookahead_samples(
        table(spark, folder, "events"), "value", 4, 1, EVENT_ORDER, "user_id", ["event_id"]
    )
    xs = [F.get("x", i).alias(f"x{i}") for i in range(4)]
    return samples.select("user_id", "pos", *xs, "target", "event_id")


@query("""
WITH s AS (
  SELECT row_number() OVER w - 1 AS pos, o_totalprice AS x0, lead(o_totalprice, 1) OVER w AS x1,
         lead(o_totalprice, 2) OVER w AS x2, lead(o_totalprice, 3) OVER w AS x3, lead(o_totalprice, 4) OVER w AS x4,
         lead(o_totalprice, 5) OVER w AS x5,
         lead(o_totalprice, 8) OVER w AS target, lead(o_orderkey, 8) OVER w AS o_orderkey
  FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey))
SELECT * FROM s WHERE target IS NOT NULL
""")
def lookahead_windows_global(spark: SparkSession, folder: str) -> DataFrame:
    samples = windows.lookahead_samples(
        table(spark, folder, "orders"), "o_totalprice", 6, 3, ["o_orderdate", "o_orderkey"],
        carry=["o_orderkey"], chunk_rows=20_000,
    )
    return samples.select(
        "pos", *[F.get("x", i).alias(f"x{i}") for i in range(6)], "target", "o_orderkey"
    )


@query("""
WITH s AS (
  SELECT user_id, row_number() OVER w - 1 AS start, value AS first_value,
         lead(event_id::DOUBLE, 4) OVER w AS last_id,
         sum(value) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS total,
         lead(event_type, 4) OVER w AS label, lead(ts, 4) OVER w AS ts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, start, first_value, last_id, round(total, 6) AS total, label, ts
FROM s WHERE ts IS NOT NULL AND start % 3 = 0
""")
def slide_windows_stride(spark: SparkSession, folder: str) -> DataFrame:
    out = windows.sliding_windows(
        table(spark, folder, "events"), ["value", "event_id"], "event_type", 5, 3, "ts",
        EVENT_ORDER, "user_id",
    )
    return out.select(
        "user_id",
        "start",
        F.get(F.get("x", 0), 0).alias("first_value"),
        F.get(F.get("x", 4), 1).alias("last_id"),
        rounded(array_sum(F.transform("x", lambda row: F.get(row, 0)))).alias("total"),
        "label",
        "ts",
    )


@query("""
WITH s AS (
  SELECT row_number() OVER w - 1 AS start,
         sum(o_totalprice) OVER (w ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING) AS total,
         lead(o_orderstatus, 59) OVER w AS label, lead(o_orderdate, 59) OVER w AS ts
  FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey))
SELECT start, round(total, 2) AS total, label, ts FROM s WHERE ts IS NOT NULL AND start % 20 = 0
""")
def slide_windows_global(spark: SparkSession, folder: str) -> DataFrame:
    out = windows.sliding_windows(
        table(spark, folder, "orders"), ["o_totalprice"], "o_orderstatus", 60, 20, "o_orderdate",
        ["o_orderdate", "o_orderkey"],
    )
    total = rounded(array_sum(F.transform("x", lambda row: F.get(row, 0))), 2)
    return out.select("start", total.alias("total"), "label", "ts")


@query(f"""
WITH e AS (SELECT epoch_us(ts) AS t, value FROM events),
g AS (SELECT min(t) AS t0, max(t) AS t1 FROM e),
k AS (SELECT unnest(generate_series(0, ((t1 - t0 - {HOUR} + {HOUR // 2}) + {HOUR // 2} - 1) // {HOUR // 2} - 1)) AS slice, t0
      FROM g)
SELECT slice, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high
FROM k JOIN e ON e.t >= k.t0 + slice * {HOUR // 2} AND e.t < k.t0 + slice * {HOUR // 2} + {HOUR}
GROUP BY slice
""")
def hopping_slices(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(micros().alias("t"), "value")
    grid = windows.SliceGrid.fit(events, "t", HOUR, HOUR // 2)
    out = windows.slice_summary(events, "t", "value", grid)
    return out.select("slice", "n", rounded("total", 4).alias("total"), "low", "high")


@query(f"""
WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS t FROM events),
g AS (SELECT min(t) AS t0, max(t) AS t1 FROM e),
k AS (SELECT unnest(generate_series(0, ((t1 - t0 - {HOUR} + {2 * HOUR}) + {2 * HOUR} - 1) // {2 * HOUR} - 1)) AS slice, t0
      FROM g)
SELECT event_id, event_type, slice
FROM k JOIN e ON e.t >= k.t0 + slice * {2 * HOUR} AND e.t < k.t0 + slice * {2 * HOUR} + {HOUR}
""")
def slice_members_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "event_type", micros().alias("t"))
    grid = windows.SliceGrid.fit(events, "t", HOUR, 2 * HOUR)
    return windows.assign_slices(events, "t", grid).drop("t")


@query("""
WITH s AS (
  SELECT lead(event_type, 4) OVER w AS event_type, lead(value, 4) OVER w AS y,
         (value + lead(value, 1) OVER w + lead(value, 2) OVER w + lead(value, 3) OVER w) / 4 AS p
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_type, round(avg(power(p - y, 2)), 6) AS mse, round(sqrt(avg(power(p - y, 2)) + 1e-6), 6) AS rmse,
       round(avg(abs(p - y)), 6) AS mae, round(100 * avg(abs((p - y) / (y + 1e-6))), 4) AS mape,
       round(100 * (1 - avg(abs(p - y)) / avg(y)), 6) AS accuracybar
FROM s WHERE event_type IS NOT NULL GROUP BY event_type
""")
def naive_forecast_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: look-ahead samples, the window mean as forecast, errors per type."""
    samples = windows.lookahead_samples(
        table(spark, folder, "events"), "value", 4, 1, EVENT_ORDER, "user_id", ["event_type"]
    )
    forecast = samples.select("event_type", (array_sum("x") / 4).alias("prediction"), "target")
    out = evaluate(forecast, ["mse", "rmse", "mae", "mape", "accuracybar"], by="event_type")
    return out.select(
        "event_type",
        *[rounded(m, 4 if m == "mape" else 6).alias(m) for m in out.columns if m != "event_type"],
    )


@query("""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
       count(*) OVER (PARTITION BY user_id) AS total
FROM events
""")
def keyed_positions(spark: SparkSession, folder: str) -> DataFrame:
    out = ordered.with_position(table(spark, folder, "events"), EVENT_ORDER, "user_id", total="total")
    return out.select("user_id", "event_id", "pos", "total")


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, row_number() OVER (
  ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
           l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS pos
FROM lineitem
""")
def global_positions(spark: SparkSession, folder: str) -> DataFrame:
    order = [
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    ]
    out = ordered.with_position(table(spark, folder, "lineitem"), order)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "pos")


@query("""
SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws(':', c_custkey, 7))) - 1
       < floor(0.8::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split
FROM customer
""")
def random_split_exact(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey")
    return sampling.random_split(customers, 0.8, "c_custkey", seed=7)


@query("""
SELECT o_orderkey, o_totalprice, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1
       < floor(0.7::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split
FROM orders
""")
def ordered_split(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return splits.ordered_split(orders, 0.7, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""
SELECT user_id, event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1
       < floor(0.75::DOUBLE * count(*) OVER (PARTITION BY user_id)) THEN 'train' ELSE 'test' END AS split
FROM events
""")
def ordered_split_keyed(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", *EVENT_ORDER)
    return splits.ordered_split(events, 0.75, EVENT_ORDER, "user_id").drop("ts")


@query("""
WITH p AS (
  SELECT user_id, ts, event_id, value, CASE WHEN row_number() OVER
         (PARTITION BY user_id ORDER BY ts, event_id) <= 40 THEN 'train' ELSE 'test' END AS split
  FROM events),
s AS (
  SELECT user_id, split, row_number() OVER w - 1 AS pos, value AS x0, lead(value) OVER w AS x1,
         lead(value, 2) OVER w AS x2, lead(value, 3) OVER w AS x3, lead(value, 4) OVER w AS target
  FROM p WINDOW w AS (PARTITION BY user_id, split ORDER BY ts, event_id))
SELECT * FROM s WHERE target IS NOT NULL
""")
def fixed_cut_windows(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", *EVENT_ORDER, "value")
    hot = ordered.hot_keys(events, "user_id") or False  # counted once for both
    cut = splits.fixed_split(events, 40, EVENT_ORDER, "user_id", hot=hot)
    out = windows.lookahead_samples(cut, "value", 4, 1, EVENT_ORDER, ["user_id", "split"], hot=hot)
    return out.select(
        "user_id", "split", "pos", *[F.get("x", i).alias(f"x{i}") for i in range(4)], "target"
    )


@query("""
WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos,
           count(*) OVER () AS n FROM orders)
SELECT o_orderkey, pos, pos // 64 AS batch_ix FROM p WHERE pos // 64 < n // 64
""")
def batches_drop_last(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    out = splits.batches(orders, ["o_orderdate", "o_orderkey"], 64, drop_last=True)
    return out.select("o_orderkey", "pos", "batch_ix")


@query("""
WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws(':', o_orderkey, 3, 2))) - 1 AS pos
           FROM orders)
SELECT o_orderkey, pos, pos // 16 AS batch_ix FROM p
""")
def shuffled_batches(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey")
    out = splits.shuffled_batches(orders, "o_orderkey", 16, seed=3, epoch=2)
    return out.select("o_orderkey", "pos", "batch_ix")


@query("SELECT p_partkey, p_brand, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 25")
def first_n(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_retailprice")
    return sampling.first_n(part, 25, ["p_retailprice", "p_partkey"])


@query("""
WITH p AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS pos
           FROM customer)
SELECT s.s_suppkey AS ord, p.pos, p.c_custkey, p.c_acctbal
FROM supplier s JOIN p ON p.pos = s.s_nationkey * 3
""")
def subset_by_index(spark: SparkSession, folder: str) -> DataFrame:
    index = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("ord"), (F.col("s_nationkey").cast("long") * 3).alias("pos")
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    out = sampling.take_positions(customers, index, ["c_acctbal", "c_custkey"])
    return out.select("ord", "pos", "c_custkey", "c_acctbal")


_PARTIES = """
  SELECT 0 AS loader_ix, c_custkey AS key, c_acctbal AS balance FROM customer
  UNION ALL SELECT 1, s_suppkey, s_acctbal FROM supplier
"""


def _parties(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [
        table(spark, folder, "customer").select(
            F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance")
        ),
        table(spark, folder, "supplier").select(
            F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")
        ),
    ]


@query(f"""
SELECT loader_ix, key, balance, row_number() OVER (ORDER BY loader_ix, key) - 1 AS pos
FROM ({_PARTIES}) u
""")
def concat_sources(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.concat_sources(_parties(spark, folder), "key")


@query(f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY loader_ix ORDER BY key) - 1 AS pos FROM ({_PARTIES}) u)
SELECT loader_ix, key, pos, pos // 32 AS batch_ix FROM p
""")
def loader_batches(spark: SparkSession, folder: str) -> DataFrame:
    out = splits.batches(sampling.union_sources(_parties(spark, folder)), "key", 32, partition_by="loader_ix")
    return out.select("loader_ix", "key", "pos", "batch_ix")


@query("""
WITH p AS (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY md5(concat_ws(':', c_custkey, 5))) - 1 AS pos,
           count(*) OVER () AS n FROM customer),
d AS (SELECT i AS draw, CAST('0x' || substr(md5(concat_ws(':', i, 5)), 1, 15) AS BIGINT) AS bits
      FROM generate_series(0, 999) t(i))
SELECT d.draw, p.c_custkey, p.c_nationkey FROM d JOIN p ON p.pos = d.bits % p.n
""")
def sample_with_replacement(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    out = sampling.sample_with_replacement(customers, 1000, "c_custkey", seed=5)
    return out.select("draw", "c_custkey", "c_nationkey")


@query("""
WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS pos FROM customer),
s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS pos FROM supplier)
SELECT pos, c_custkey, s_suppkey FROM c JOIN s USING (pos)
""")
def positional_join(spark: SparkSession, folder: str) -> DataFrame:
    out = ordered.positional_join(
        table(spark, folder, "customer").select("c_custkey", "c_acctbal"),
        table(spark, folder, "supplier").select("s_suppkey", "s_acctbal"),
        ["c_acctbal", "c_custkey"],
        ["s_acctbal", "s_suppkey"],
    )
    return out.select("pos", "c_custkey", "s_suppkey")


@query("""
WITH d AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS x,
                  (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_ix FROM documents),
m AS (SELECT batch_ix, max(len(x)) AS padded FROM d GROUP BY batch_ix)
SELECT doc_id, batch_ix, len(x)::INTEGER AS len, padded::INTEGER AS padded, list_sum(x)::DOUBLE AS total,
       list_last(x)::DOUBLE * (len(x) = padded)::INTEGER AS last_value
FROM d JOIN m USING (batch_ix)
""")
def pad_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Word lengths of whole documents, padded to the longest of 16."""
    words = F.transform(F.split("text", " "), lambda w: F.length(w).cast("double"))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    padded = splits.padded_batches(docs, words, "doc_id", 16, length=F.size(F.split("text", " ")), name="x")
    return padded.select(
        "doc_id",
        "batch_ix",
        "len",
        F.size("x").alias("padded"),
        array_sum("x").alias("total"),
        F.element_at("x", -1).alias("last_value"),
    )


@query("""
WITH s AS (SELECT user_id, row_number() OVER w - 1 AS pos, value AS a, lead(value, 1) OVER w AS b
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, pos, CASE WHEN a = 0 THEN NULL WHEN (b - a) / a <= -0.02 THEN 0 WHEN (b - a) / a > 0.02 THEN 2 ELSE 1 END AS bin
FROM s WHERE b IS NOT NULL
""")
def bin_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The relative change to the next value, in three classes; none from a zero."""
    pairs = windows.lookahead_samples(
        table(spark, folder, "events"), "value", 1, 1, EVENT_ORDER, "user_id"
    )
    now = F.get("x", 0)
    change = F.try_divide(F.col("target") - now, now)
    return pairs.select("user_id", "pos", bin_label(change).alias("bin"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws(':', l_orderkey, l_linenumber, 11))) - 1
       < floor(0.8::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split
FROM lineitem
""")
def random_split_composite_id(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    return sampling.random_split(lines, 0.8, ["l_orderkey", "l_linenumber"], seed=11)


@query("""
WITH k AS (SELECT unnest(generate_series(0, 997)) AS slice)
SELECT slice, count(*) AS n, round(sum(value), 6) AS total, min(value) AS low, max(value) AS high
FROM k JOIN events ON value >= 0.0::DOUBLE + slice * 0.1::DOUBLE
                  AND value < 0.0::DOUBLE + slice * 0.1::DOUBLE + 0.3::DOUBLE
GROUP BY slice
""")
def hopping_slices_fractional(spark: SparkSession, folder: str) -> DataFrame:
    """Slices of 0.3 every 0.1, whose edges no floating division finds exactly."""
    values = table(spark, folder, "events").select("value")
    out = windows.slice_summary(values, "value", "value", windows.SliceGrid(0.0, 0.3, 0.1, 998))
    return out.select("slice", "n", rounded("total").alias("total"), "low", "high")


@query("""
WITH k AS (SELECT unnest(generate_series(0, 7999)) AS slice)
SELECT slice, count(*) AS n FROM k JOIN events ON value >= 1.7::DOUBLE + slice * 0.0125::DOUBLE
                                AND value < 1.7::DOUBLE + slice * 0.0125::DOUBLE + 0.7::DOUBLE
GROUP BY slice
""")
def hopping_slices_overlapping(spark: SparkSession, folder: str) -> DataFrame:
    """Each value lies in 56 slices, but is counted in one interval."""
    values = table(spark, folder, "events").select("value")
    return windows.slice_summary(values, "value", "value", windows.SliceGrid(1.7, 0.7, 0.0125, 8000)).select("slice", "n")


@query("""
WITH p AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders)
SELECT pos // 50 AS batch_ix, (pos % 50)::INTEGER AS place, o_orderkey, round(o_totalprice * 0.5, 4) AS prediction FROM p
""")
def scored_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Scored rows handed to the caller in batches of 50 consecutive rows."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderdate", rounded(F.col("o_totalprice").cast("double") * 0.5, 4).alias("prediction")
    )
    out = splits.ordered_batches(orders, ["o_orderdate", "o_orderkey"], 50, ["o_orderkey", "prediction"])
    rows = F.posexplode(F.arrays_zip("o_orderkey", "prediction")).alias("place", "r")
    return out.select("batch_ix", rows).select("batch_ix", "place", "r.o_orderkey", "r.prediction")


@query("""
SELECT o_orderkey, o_orderdate, o_totalprice, CASE WHEN row_number() OVER (
         ORDER BY o_orderdate NULLS FIRST, o_orderkey NULLS FIRST, o_totalprice NULLS FIRST) - 1
       < floor(0.35::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split
FROM orders
""")
def ordered_split_ties(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered by a date that many orders share: the cut falls inside a day."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return splits.ordered_split(orders, 0.35, "o_orderdate")


@query("""
WITH n AS (SELECT count(*) // 3 AS cut FROM lineitem)
SELECT l_returnflag, l_linestatus, l_linenumber, CASE WHEN row_number() OVER (
         ORDER BY l_returnflag NULLS FIRST, l_linestatus NULLS FIRST, l_linenumber NULLS FIRST) - 1
       < cut THEN 'train' ELSE 'test' END AS split
FROM lineitem, n
""")
def fixed_split_ties(spark: SparkSession, folder: str) -> DataFrame:
    """A cut after a third of the rows, through rows that are equal in every column."""
    lines = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return splits.fixed_split(lines, lines.count() // 3, "l_returnflag")
