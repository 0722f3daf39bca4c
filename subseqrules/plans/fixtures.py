"""Series, samples, intervals and labels that the queries derive from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_series(spark, sf) -> DataFrame:
    """Each event type's values in order of time."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(F.col("event_type").alias("series_id"), F.lit(0).alias("attr_id"), (F.row_number().over(w).cast("long") - 1).alias("t"), F.col("value").alias("v"))


def hour():
    return F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3_600_000_000)


def every(values: DataFrame, c) -> DataFrame:
    """All whole numbers t from the least to the largest value of c."""
    return values.agg(F.min(c).cast("long").alias("lo"), F.max(c).cast("long").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("t"))


def hourly(spark, sf) -> DataFrame:
    """Every hour from the first to the last event for each event type (attr_id by name from 0), the mean value, NULL where there is none."""
    ev = table(spark, sf, "events")
    names = ev.select("event_type").distinct().withColumn("attr_id", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("int"))
    grid = every(ev, hour()).join(F.broadcast(names), F.lit(True))  # a row for each event type
    mean = ev.select("event_type", hour().alias("t"), "value").groupBy("event_type", "t").agg(F.avg("value").alias("v"))
    return grid.join(mean, ["event_type", "t"], "left").select(F.lit("h").alias("series_id"), "attr_id", "t", "v")


def daily(spark, sf) -> DataFrame:
    """Quantity a day for each return flag (attr_id by name), NULL where nothing shipped."""
    li = table(spark, sf, "lineitem").select("l_returnflag", F.datediff(F.to_date("l_shipdate"), F.to_date(F.lit("1995-01-02"))).cast("long").alias("t"), "l_quantity")
    names = li.select("l_returnflag").distinct().withColumn("attr_id", (F.row_number().over(Window.orderBy("l_returnflag")) - 1).cast("int"))
    grid = every(li, F.col("t")).join(F.broadcast(names), F.lit(True))  # a row for each return flag
    sums = li.groupBy("l_returnflag", "t").agg(F.sum("l_quantity").alias("v"))
    return grid.join(sums, ["l_returnflag", "t"], "left").select(F.lit("d").alias("series_id"), "attr_id", "t", "v")


def samples(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    split = F.when(F.col("vec_id") % 2 == 0, "train").otherwise("test")
    return e.select(F.col("vec_id").alias("sample_id"), F.col("label").cast("double").alias("label"), F.col("embedding").cast("array<double>").alias("vals"), split.alias("split"))


def order_intervals(spark, sf) -> DataFrame:
    """(key, a, b, id) of each order: a day and a length of 1 to 30."""
    o = table(spark, sf, "orders")
    first = o.agg(F.min(F.to_date("o_orderdate")).alias("d0"))
    o = o.join(F.broadcast(first), F.lit(True))  # one row
    a = F.datediff(F.to_date("o_orderdate"), F.col("d0")).cast("long")
    return o.select(F.col("o_custkey").alias("key"), a.alias("a"), (a + 1 + F.col("o_orderkey") % 30).alias("b"), F.col("o_orderkey").alias("id"))


def point_labels(spark, sf) -> DataFrame:
    """Every hour; 1 where an error event has a value over 100."""
    ev = table(spark, sf, "events")
    hit = ev.where("event_type = 'error' and value > 100").select(hour().alias("t")).distinct().withColumn("one", F.lit(1))
    return every(ev, hour()).join(hit, "t", "left").select("t", F.coalesce("one", F.lit(0)).alias("label"))


def busy_hours(spark, sf) -> DataFrame:
    """Every hour; y_pred 1 where the number of events is over its 0.9 quantile."""
    ev = table(spark, sf, "events")
    n = ev.groupBy(hour().alias("t")).agg(F.count("*").alias("n"))
    n = every(ev, hour()).join(n, "t", "left").fillna(0, ["n"])
    top = n.agg(F.percentile("n", F.lit(0.9)).alias("q"))
    return n.join(F.broadcast(top), F.lit(True)).select("t", (F.col("n") > F.col("q")).cast("int").alias("y_pred"))


EVENTS = "fx AS (SELECT event_type AS series_id, 0 AS attr_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, value AS v FROM events)"
HOUR = "CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000) AS BIGINT)"
HOURS = f"(SELECT unnest(range(min(h), max(h) + 1)) AS t FROM (SELECT {HOUR} AS h FROM events)) r"
HOURLY = f"""nm AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS attr_id FROM (SELECT DISTINCT event_type FROM events)),
gr AS (SELECT * FROM nm, {HOURS}), mv AS (SELECT event_type, {HOUR} AS t, avg(value) AS v FROM events GROUP BY ALL),
hx AS (SELECT 'h' AS series_id, attr_id, gr.t AS t, mv.v AS v FROM gr LEFT JOIN mv USING (event_type, t))"""
DAILY = """li AS (SELECT l_returnflag, date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) AS t, l_quantity FROM lineitem),
nm AS (SELECT l_returnflag, CAST(row_number() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS attr_id FROM (SELECT DISTINCT l_returnflag FROM li)),
gr AS (SELECT * FROM nm, (SELECT unnest(range(min(t), max(t) + 1)) AS t FROM li) r), sv AS (SELECT l_returnflag, t, sum(l_quantity) AS v FROM li GROUP BY ALL),
dx AS (SELECT 'd' AS series_id, attr_id, gr.t AS t, sv.v AS v FROM gr LEFT JOIN sv USING (l_returnflag, t))"""
SAMPLES = "sm AS (SELECT vec_id AS sample_id, CAST(label AS DOUBLE) AS label, CAST(embedding AS DOUBLE[]) AS vals, CASE WHEN vec_id % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM embeddings)"
ORDERS = """oi AS (SELECT o_custkey AS key, date_diff('day', (SELECT min(CAST(o_orderdate AS DATE)) FROM orders), CAST(o_orderdate AS DATE)) AS a,
date_diff('day', (SELECT min(CAST(o_orderdate AS DATE)) FROM orders), CAST(o_orderdate AS DATE)) + 1 + o_orderkey % 30 AS b, o_orderkey AS id FROM orders)"""
LABELS = f"pl AS (SELECT r.t AS t, CASE WHEN r.t IN (SELECT {HOUR} FROM events WHERE event_type = 'error' AND value > 100) THEN 1 ELSE 0 END AS label FROM {HOURS})"
BUSY = f"""hn AS (SELECT r.t AS t, coalesce(c.n, 0) AS n FROM {HOURS} LEFT JOIN (SELECT {HOUR} AS t, count(*) AS n FROM events GROUP BY ALL) c ON c.t = r.t),
bp AS (SELECT t, CASE WHEN n > (SELECT quantile_cont(n, 0.9) FROM hn) THEN 1 ELSE 0 END AS y_pred FROM hn)"""
