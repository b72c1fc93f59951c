"""The library's inputs derived from the driver's tables, in Spark and as common table expressions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.operators.verification import keep_last


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place():
    return F.when(F.col("user_id") % 2 == 0, "top").otherwise("bottom").alias("location")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").where("event_type = 'view'").select(_place(), F.col("ts").cast("timestamp").alias("time"), "value", "event_id")
    return keep_last(df, ["location", "time"], ["event_id"]).drop("event_id")


def raw_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").where("event_type <> 'view'").select(
        _place(), F.col("event_type").alias("model"), (hour - F.make_dt_interval(days=(1 + F.col("user_id") % 7).cast("int"))).alias("issued_at"), hour.alias("valid_time"),
        F.when(F.col("event_id") % 5 == 0, "live").otherwise("previous_runs").alias("source"), "value", "event_id",
    )


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_last(raw_forecasts(spark, sf_dir), ["location", "model", "issued_at", "valid_time"], ["event_id"]).drop("event_id")


def station_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily series by order priority: mean price of a day's orders, in thousands."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("location"), F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") / 1000).alias("v"))
    return df.groupBy("location", "day").agg(F.avg("v").alias("v"))


def all_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.lit("all").alias("location"), F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") / 1000).alias("v"))
    return df.groupBy("location", "day").agg(F.avg("v").alias("v"))


def model_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second daily series: mean price of a day's shipped lines, in hundreds."""
    df = table(spark, sf_dir, "lineitem").select(F.lit("all").alias("location"), F.to_date("l_shipdate").alias("day"), (F.col("l_extendedprice") / 100).alias("v"))
    return df.groupBy("location", "day").agg(F.avg("v").alias("v"))


def long_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series of all orders four times one after another, 2,557 days apart and 3 higher each time."""
    df = all_days(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return df.select("location", F.date_add("day", F.col("k") * 2557).alias("day"), (F.col("v") + 3 * F.col("k")).alias("v"))


def ensembles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ensemble of 64 members for each vector, issued on successive days, with the label as lead day."""
    df = table(spark, sf_dir, "embeddings")
    issued = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("vec_id") % 25) * 86_400)
    return df.select(F.lit("top").alias("location"), F.lit("ens").alias("ensemble"), issued.alias("issued_at"), (issued + F.make_dt_interval(days=(F.col("label") % 5).cast("int"), hours=(F.col("vec_id") % 24).cast("int"))).alias("valid_time"), issued.alias("start"), F.transform("embedding", lambda x: x.cast("double") * 20 + 20).alias("members"), "vec_id")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("cam"), (F.col("user_id") % 3).cast("string")).alias("camera"), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("time")).distinct()


_PLACE = "CASE WHEN user_id % 2 = 0 THEN 'top' ELSE 'bottom' END"
OBS = f"obs AS (SELECT {_PLACE} AS location, ts AS time, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2)"
RAW = f"""raw AS (SELECT {_PLACE} AS location, event_type AS model, date_trunc('hour', ts) - to_days((1 + user_id % 7)::INT) AS issued_at, date_trunc('hour', ts) AS valid_time,
  CASE WHEN event_id % 5 = 0 THEN 'live' ELSE 'previous_runs' END AS source, value, event_id FROM events WHERE event_type <> 'view')"""
FC = f"{RAW}, fc AS (SELECT location, model, issued_at, valid_time, arg_max(source, event_id) AS source, arg_max(value, event_id) AS value FROM raw GROUP BY ALL)"
NEAR = """SELECT t.location, t.valid_time, arg_min(o.value, {d: abs(epoch_us(o.time) - epoch_us(t.valid_time)), t: epoch_us(o.time)}) AS observed
  FROM (SELECT DISTINCT location, valid_time FROM fc) t JOIN obs o ON t.location = o.location AND o.time BETWEEN t.valid_time - INTERVAL 30 MINUTE AND t.valid_time + INTERVAL 30 MINUTE
  GROUP BY t.location, t.valid_time"""
PAIRS = f"""{OBS}, {FC}, near AS ({NEAR}),
pairs AS (SELECT fc.*, near.observed, fc.value - near.observed AS error, abs(fc.value - near.observed) AS abs_error, (epoch_us(fc.valid_time) - epoch_us(fc.issued_at)) / 3.6e9 AS lead_hours,
  round_even((epoch_us(fc.valid_time) - epoch_us(fc.issued_at)) / 8.64e10, 0)::INT AS lead_day,
  CASE WHEN hour(timezone('America/Vancouver', timezone('UTC', fc.valid_time))) < 6 THEN 'Night' WHEN hour(timezone('America/Vancouver', timezone('UTC', fc.valid_time))) < 12 THEN 'Morning'
       WHEN hour(timezone('America/Vancouver', timezone('UTC', fc.valid_time))) < 18 THEN 'Afternoon' ELSE 'Evening' END AS part_of_day
  FROM fc JOIN near USING (location, valid_time) WHERE fc.valid_time >= fc.issued_at)"""
STATION = "station AS (SELECT o_orderpriority AS location, o_orderdate::DATE AS day, avg(o_totalprice / 1000) AS v FROM orders GROUP BY 1, 2)"
ALL_DAYS = "alldays AS (SELECT 'all' AS location, o_orderdate::DATE AS day, avg(o_totalprice / 1000) AS v FROM orders GROUP BY 1, 2)"
LONG_DAYS = f"{ALL_DAYS}, longd AS (SELECT location, (day + (2557 * k)::INT)::DATE AS day, v + 3 * k AS v FROM alldays, (SELECT unnest(range(4)) AS k))"
MODEL = "model AS (SELECT 'all' AS location, l_shipdate::DATE AS day, avg(l_extendedprice / 100) AS v FROM lineitem GROUP BY 1, 2)"
DOY = "dayofyear(make_date(2001, month(day), CASE WHEN month(day) = 2 AND day(day) = 29 THEN 28 ELSE day(day) END))"
ENS = """ens AS (SELECT 'top' AS location, 'ens' AS ensemble, make_timestamp((1704067200 + (vec_id % 25) * 86400) * 1000000) AS issued_at,
  make_timestamp((1704067200 + (vec_id % 25) * 86400) * 1000000) + to_days((label % 5)::INT) + to_hours((vec_id % 24)::INT) AS valid_time, list_transform(embedding, lambda x: x::DOUBLE * 20 + 20) AS members, vec_id FROM embeddings)"""
