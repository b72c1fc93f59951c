"""Queries of logs that are written and read again, and of fetched payloads, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.plans import testbed as tb
from nimbora.plans.catalog import _CYCLE, _query, _r
from nimbora.session import new_folder
from nimbora.sources import logs, payloads

MODELS = ("click", "purchase", "signup", "error")
PLACES = 40  # locations that are asked for, of the users by remainder


def _written_log(spark: SparkSession, sf_dir: str) -> str:
    """A log of which a third of the files hold run_init as text, a third as a number without values, and a third not at all."""
    fc = tb.forecasts(spark, sf_dir)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.hour("valid_time") % 3
    run = F.when(F.col("source") == "live", stamp(F.col("issued_at") - F.make_dt_interval(hours=F.lit(4))))
    rows = fc.withColumns({"kind": kind, "run_init": run, "variable": F.lit("t"), "fetched_at": stamp("issued_at")})
    rows = rows.withColumns({"issued_at": stamp("issued_at"), "valid_time": stamp("valid_time")})
    root = new_folder(spark, "log")
    logs.write_log(rows.where("kind = 0"), root, logs.FORECASTS, "issued_date")
    logs.write_log(rows.where("kind = 1"), root, logs.FORECASTS.replace(", run_init string", ""), "issued_date")
    logs.write_log(rows.where("kind = 2").withColumn("run_init", F.lit(None).cast("int")), root, logs.FORECASTS.replace("run_init string", "run_init int"), "issued_date")
    return root


@_query("s1_forecast_log", f"""WITH {tb.FC}, i AS (SELECT *, CASE WHEN source = 'live' AND hour(valid_time) % 3 = 0 THEN issued_at - INTERVAL 4 HOUR END AS run_init, {_CYCLE} AS c FROM fc),
a AS (SELECT model, median((epoch_us(issued_at) - epoch_us(run_init)) / 1e6) FILTER (run_init IS NOT NULL) AS age FROM i GROUP BY model),
g AS (SELECT i.*, round_even((epoch_us(issued_at) / 1e6 - coalesce(age, 32400)) / c, 0)::BIGINT * c AS guess, floor(epoch_us(issued_at) / 1e6 / c)::BIGINT * c AS fl FROM i JOIN a USING (model))
SELECT location, model, issued_at, valid_time, source, value, run_init,
  CASE WHEN run_init IS NOT NULL THEN run_init WHEN source <> 'live' THEN make_timestamp(fl * 1000000) WHEN guess <= epoch_us(issued_at) / 1e6 THEN make_timestamp(guess * 1000000) ELSE make_timestamp(fl * 1000000) END AS init_time,
  CASE WHEN run_init IS NOT NULL THEN 'logged' WHEN source <> 'live' THEN 'cycle' ELSE 'estimated' END AS init_basis FROM g""")
def _(spark, sf_dir):
    df = logs.read_forecasts(spark, _written_log(spark, sf_dir), "t", cycles={"click": 12})
    return df.select("location", "model", "issued_at", "valid_time", "source", "value", "run_init", "init_time", "init_basis")


def _payloads(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """(folder, requests): one answer for each place and pass. Every fifth place fails at first, every fifteenth twice; every seventh lacks one model."""
    df = tb.table(spark, sf_dir, "events").select((F.col("user_id") % PLACES).alias("place"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), "event_type", "value", "event_id")
    df = df.withColumn("value", F.when(~((F.col("place") % 7 == 0) & (F.col("event_type") == "purchase")), F.col("value")))
    hours = df.groupBy("place", "hour").agg(*[F.max_by(F.when(F.col("event_type") == m, F.col("value")), F.when(F.col("event_type") == m, F.col("event_id"))).alias(m) for m in MODELS])
    rows = hours.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("hour", *MODELS))).alias("h"))
    fields = {"time": F.transform("h", lambda x: F.date_format(x["hour"], "yyyy-MM-dd'T'HH:mm"))} | {f"t_{m}": F.col(f"h.{m}") for m in MODELS}
    hourly = F.named_struct(*[x for name, field in fields.items() for x in (F.lit(name), field)])
    body = F.to_json(F.named_struct(F.lit("hourly"), hourly), {"ignoreNullFields": "false"})
    rows = rows.select("place", F.concat(F.lit("u"), F.col("place").cast("string")).alias("request"), body.alias("body"), F.explode(F.array(F.lit(1), F.lit(2))).alias("pass"))
    good = F.col("place") % F.when(F.col("pass") == 1, 5).otherwise(15) != 0
    folder = new_folder(spark, "payloads")
    payloads.write_payloads(rows.select("request", "pass", F.when(good, 200).otherwise(503).alias("status"), F.when(good, F.col("body")).alias("body")), folder)
    return folder, rows.select("request").distinct()


def _inits(spark: SparkSession, moved: tuple[str, ...] = ()) -> DataFrame:
    return spark.createDataFrame([(m, "2024-01-01T06:00:00Z" if m in moved else "2024-01-01T00:00:00Z") for m in MODELS], "domain string, init string")


_ASKED = f"""e AS (SELECT user_id % {PLACES} AS place, event_type AS model, date_trunc('hour', ts) AS valid_time, arg_max(value, event_id) AS value FROM events WHERE event_type IN ({", ".join(f"'{m}'" for m in MODELS)}) AND value IS NOT NULL GROUP BY ALL),
lg AS (SELECT * FROM e WHERE place % 15 <> 0 AND NOT (place % 7 = 0 AND model = 'purchase')), req AS (SELECT DISTINCT user_id % {PLACES} AS place FROM events)"""


@_query("k8_logged_forecasts", f"WITH {_ASKED} SELECT 'u' || place::VARCHAR AS location, model, valid_time, round(value + 0.0000001, 4) AS value, CASE WHEN model <> 'purchase' THEN '2024-01-01T00:00:00Z' END AS run_init FROM lg")
def _(spark, sf_dir):
    answers, _ = payloads.two_passes(spark, *_payloads(spark, sf_dir))
    log = payloads.logged_forecasts(answers, MODELS, ["t"], _inits(spark), _inits(spark, ("purchase",)))
    return log.select("location", "model", "valid_time", *_r("value"), "run_init")


@_query("k8_failed_requests", f"WITH {_ASKED} SELECT 'u' || place::VARCHAR AS request, 503 AS status FROM req WHERE place % 15 = 0")
def _(spark, sf_dir):
    return payloads.two_passes(spark, *_payloads(spark, sf_dir))[1].select("request", "status")


@_query("k8_lost_models", f"""WITH {_ASKED}, m AS (SELECT unnest([{", ".join(f"'{m}'" for m in MODELS)}]) AS model)
SELECT 'u' || place::VARCHAR AS location, string_agg(model, ',' ORDER BY model) AS missing FROM (SELECT place, model FROM req, m WHERE place % 15 <> 0) ANTI JOIN lg USING (place, model) GROUP BY place""")
def _(spark, sf_dir):
    answers, _ = payloads.two_passes(spark, *_payloads(spark, sf_dir))
    log = payloads.logged_forecasts(answers, MODELS, ["t"], _inits(spark), _inits(spark))
    return payloads.lost_models(log, answers, MODELS).withColumn("missing", F.array_join("missing", ","))
