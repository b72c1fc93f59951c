"""Logs, parsers and streams."""

import datetime as dt
import json

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from nimbora.sources import logs, parsers
from nimbora.streaming import ingest

ROW = {"location": "a", "model": "m", "issued_at": "2024-01-01T00:00:00Z", "valid_time": "2024-01-02T00:00", "variable": "t", "value": 1.0, "source": "live", "fetched_at": "2024-01-01T01:00:00Z"}


def test_log_round_trip_last_write_wins(spark, tmp_path):
    root = str(tmp_path / "log")
    for day, value in (("2024-01-01", 1.0), ("2024-01-02", 2.0)):
        logs.write_log(spark.createDataFrame([ROW | {"value": value, "fetched_at": f"{day}T01:00:00Z"}]), root, logs.FORECASTS, "issued_date")
    logs.write_log(spark.createDataFrame([ROW | {"variable": "u"}]), root, logs.FORECASTS, "issued_date")
    got = logs.read_forecasts(spark, root, "t").collect()
    assert [(r.value, r.valid_time, r.run_init) for r in got] == [(2.0, dt.datetime(2024, 1, 2), None)]
    plan = logs.read_forecasts(spark, root, "t", ["a"])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "variable" in plan


def test_untyped_optional_column(spark, tmp_path):
    pq.write_table(pa.table({"a": ["x"], "run_init": pa.nulls(1)}), tmp_path / "one.parquet")
    pq.write_table(pa.table({"a": ["y"], "run_init": ["r"]}), tmp_path / "two.parquet")
    got = logs.read_untyped(spark, str(tmp_path), "a string, run_init string").collect()
    assert sorted((r.a, r.run_init) for r in got) == [("x", None), ("y", "r")]


def test_reanalysis_takes_the_latest_fetch(spark, tmp_path):
    rows = [("a", "2024-01-01", "t", v, "era5_land", f) for v, f in ((1.0, "2024-02-01"), (2.0, "2024-03-01"))]
    spark.createDataFrame(rows, logs.REANALYSIS).write.parquet(str(tmp_path / "r"))
    assert [(r.t, r.s) for r in logs.read_reanalysis(spark, str(tmp_path / "r"), ["t", "s"]).collect()] == [(2.0, None)]


def test_save_if_changed(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    root = str(tmp_path / "c")
    assert [logs.save_if_changed(df, root, s, ["a"]) for s in ("1", "2")] == [True, False]
    assert logs.save_if_changed(df.withColumn("b", F.lit("y")), root, "3", ["a"])


def test_chunks(spark):
    got = [tuple(map(str, r)) for r in logs.month_chunks(spark, "2000-01-01", "2002-06-30").collect()]
    assert got == [("2000-01-01", "2000-12-31"), ("2001-01-01", "2001-12-31"), ("2002-01-01", "2002-06-30")]


def test_settled_inits(spark):
    s = "domain string, init string"
    got = logs.settled_inits(spark.createDataFrame([("a", "1"), ("b", "1")], s), spark.createDataFrame([("a", "1"), ("b", "2")], s)).collect()
    assert {r.domain: r.init for r in got} == {"a": "1", "b": None}


def body(spark, payload, **extra):
    return spark.createDataFrame([extra | {"body": json.dumps(payload)}])


def test_forecast_json_takes_the_longest_model(spark):
    payload = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temp_gem": [1.0, None], "temp_gem_hr": [2.0, 3.0], "other_x": [1, 1]}}
    got = parsers.parse_forecast_json(body(spark, payload, location="a"), "body", ["gem", "gem_hr"], ["temp"]).collect()
    assert sorted((r.model, r.variable, r.value) for r in got) == [("gem", "temp", 1.0), ("gem_hr", "temp", 2.0), ("gem_hr", "temp", 3.0)]


def test_ensemble_and_previous_runs_json(spark):
    payload = {"hourly": {"time": ["2024-01-05T00:00"], "t": [1.0], "t_member01": [2.0]}}
    got = parsers.parse_ensemble_json(body(spark, payload, location="a"), "body", "geps", ["t"]).collect()
    assert sorted((r.model, r.value) for r in got) == [("geps_member00", 1.0), ("geps_member01", 2.0)]
    payload = {"hourly": {"time": ["2024-01-05T00:00"], "t_previous_day2": [1.0], "t": [9.0]}}
    got = parsers.parse_previous_runs_json(body(spark, payload, location="a"), "body", ["t"]).collect()
    assert [(r.issued_at, r.value) for r in got] == [(dt.datetime(2024, 1, 3), 1.0)]
    assert sorted(r.field for r in parsers.previous_run_fields(spark, ["t"], [1, 2]).collect()) == ["t_previous_day1", "t_previous_day2"]


def test_daily_json_and_index_text_and_geojson(spark):
    payload = {"daily": {"time": ["2024-01-01", "2024-01-02"], "t": [1.5, None]}}
    assert [(str(r.date), r.variable, r.value) for r in parsers.parse_daily_json(body(spark, payload), "body").collect()] == [("2024-01-01", "t", 1.5)]
    lines = spark.createDataFrame([(" SEAS  YR   ANOM",), (" NDJ 1950  -1.53",), ("",)], "value string")
    assert [tuple(r) for r in parsers.parse_index_text(lines).collect()] == [("NDJ", 1950, -1.53)]
    payload = {"features": [{"properties": {"date": "1950-01", "temp_mean__temp_moyenne": v}} for v in (-3.0, None, -9999.9)]}
    assert [tuple(r) for r in parsers.parse_monthly_geojson(body(spark, payload), "body").collect()] == [("1950-01", -3.0)]


def test_station_csv(spark, tmp_path):
    """Units, the order of candidates, noise of sums, quotes, missing times, and a header of its own in each file."""
    (tmp_path / "a.csv").write_text('Banner, "of a station"\nair_temperature, snw_dpth, pcpn_amt_pst1hr, time\n 1.2, -3, -0.4, 2024-01-01 04:00:00\nNone, 12, 1, 2024-03-10 02:30:00\n None, "10", None, 2024-07-01 04:00:00\n5, 5, 5, None\n')
    (tmp_path / "b.csv").write_text("Banner\ntime, air_temp, air_temperature, newsnow\n2024-01-02 04:00:00, None, 7, -1\n2024-01-02 05:00:00, 6, 8, 2.5\n")
    columns = {"temperature_2m": (["air_temp", "air_temperature"], 1.0), "snow_depth": (["snw_dpth"], 0.01), "precipitation": (["pcpn_amt_pst1hr"], 1.0), "snowfall": (["newsnow"], 1.0), "wind": (["none"], 1.0)}
    got = parsers.read_station_csv(spark, str(tmp_path), columns).collect()
    assert sorted((r.time.isoformat(), r.variable, r.value) for r in got) == [
        ("2024-01-01T12:00:00", "precipitation", 0.0), ("2024-01-01T12:00:00", "snow_depth", -0.03), ("2024-01-01T12:00:00", "temperature_2m", 1.2),
        ("2024-01-02T12:00:00", "snowfall", 0.0), ("2024-01-02T12:00:00", "temperature_2m", 7.0), ("2024-01-02T13:00:00", "snowfall", 2.5), ("2024-01-02T13:00:00", "temperature_2m", 6.0),
        ("2024-07-01T11:00:00", "snow_depth", 0.1),
    ]


def test_station_json(spark):
    rows = [{"measurementDateTime": "2024-01-01T00:00:00Z", "airTempAvg": -1.5, "hourlyPrecip": -0.2, "snowHeight": -4, "windSpeedAvg": None}, {"measurementDateTime": None, "airTempAvg": 3}]
    got = parsers.parse_station_json(body(spark, rows, location="a"), "body").collect()
    assert sorted((r.location, r.time, r.variable, r.value) for r in got) == [("a", dt.datetime(2024, 1, 1), "precipitation", 0.0), ("a", dt.datetime(2024, 1, 1), "snow_depth", -0.04), ("a", dt.datetime(2024, 1, 1), "temperature_2m", -1.5)]


def test_station_export(spark):
    t = "2024-01-01T00:00:00Z"
    rows = [
        (t, "s1", "snow_depth", "median", "-5", ""), (t, "s1", "snow_depth", "point", "7", ""), (t, "s1", "air_temperature", "point", "1.23456", "suspect"),
        (t, "s1", "air_temperature", "point", "-1.23456", "good"), (t, "s2", "relative_humidity", "point", "81", None), (t, "s2", "relative_humidity", "point", None, None),
    ]
    got = parsers.parse_station_export(spark.createDataFrame(rows, "time_utc string, site_id string, variable string, statistic string, value string, quality string")).collect()
    assert sorted((r.site_id, r.variable, r.value) for r in got) == [("s1", "snow_depth", -0.05), ("s1", "temperature_2m", -1.235), ("s2", "relative_humidity_2m", 81.0)]


def test_requests_refuse_unknown_models(spark):
    points, spans = spark.createDataFrame([("a", 54.5, -128.6)], "location string, latitude double, longitude double"), logs.month_chunks(spark, "2000-01-01", "2000-12-31")
    assert parsers.request_urls(spark, "http://x", points, spans, ["m"], ["m"]).first().url == "http://x?latitude=54.5&longitude=-128.6&models=m&start_date=2000-01-01&end_date=2000-12-31"
    try:
        parsers.request_urls(spark, "http://x", points, spans, ["best_match"], ["m"])
        raise AssertionError("not refused")
    except ValueError:
        pass


def test_json_rows_have_nulls_for_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "a int, b double")
    assert [json.loads(r.json) for r in parsers.to_json_rows(df).orderBy("json").collect()] == [{"a": 1, "b": None}, {"a": 2, "b": 0.5}]


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(minutes=20 * i), float(i), i % 3) for i in range(30)]
    root = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "location string, ts timestamp, v double, k int")
    df.write.parquet(root)
    stream = ingest.read_stream(spark, root, df.schema)
    q = ingest.hourly_means(stream).writeStream.outputMode("append").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("hours").where("n = 3").count() >= 6
    target = str(tmp_path / "last")
    ingest.keep_last_table(stream, target, ["location", "k"], ["ts"], str(tmp_path / "ck")).awaitTermination(60)
    assert {r.k: r.v for r in ingest.read_last(spark, target, ["location", "k"], ["ts"]).collect()} == {0: 27.0, 1: 28.0, 2: 29.0}
