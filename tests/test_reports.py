"""Whole reports over the driver's smallest tables."""

import pytest
from pyspark.sql import functions as F

from nimbora.plans import reports
from nimbora.plans import testbed as tb

SF = "/root/testdata/sf0.01"


def test_verification_report(spark):
    got = reports.verification_report(tb.forecasts(spark, SF), tb.observations(spark, SF), window_days=10, min_train=3, block="week")
    assert {name: df.count() > 0 for name, df in got.items()} == {name: True for name in got}
    assert "blend" in {r.model for r in got["overall"].collect()}


def test_live_and_grid(spark):
    fc, obs = tb.forecasts(spark, SF), tb.observations(spark, SF)
    stamp = lambda t: F.lit(t).cast("timestamp")
    grid = reports.forecast_grid(fc, stamp("2024-01-01"), stamp("2024-02-10")).collect()
    assert grid and all(len(r.times) == len(r["values"]) for r in grid)
    pairs = reports.verification.align(fc, obs)
    band = reports.blend.residual_quantiles(pairs)
    past = reports.past_day_ahead_blend(fc, pairs, band, stamp("2024-01-15"), stamp("2024-01-25"), window_days=14, min_train=2)
    assert all(r.lower is None or r.lower <= r.value for r in past.collect())


def test_season_reports(spark):
    daily = tb.station_days(spark, SF)
    assert reports.season_chart(daily, "winter", (1996, 1999))["band"].count() > 300
    s = reports.season_summary(tb.all_days(spark, SF), "winter", 2000, (1996, 1999)).collect()
    assert s and all(0 <= r.pct <= 100 and 1 <= r.rank <= r.out_of for r in s)
    days = reports.unusual_days(daily, daily.where(F.year("day") == 2000), (1996, 1999))
    assert days.where("label is null").count() == 0
    shifted = daily.withColumn("day", F.date_add("day", 10))
    assert reports.season_extension(daily, shifted).count() > 0


def test_masked(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert reports.masked(df, ["b"], False).first().b is None and reports.masked(df, ["b"], True).first().b == 2.0
    with pytest.raises(ValueError):
        reports.masked(df, ["b"], None)
