"""Series with very many readings in a short time, and means that two branches of a plan may compute apart."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from nimbora.operators import asof, history
from nimbora.plans import reports

T0 = np.datetime64("2024-01-01T00:00:00", "us")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def dense(rng, n, name):
    at = np.unique(rng.integers(0, 3_600_000_000, n))
    return pd.DataFrame({name: T0 + at.astype("timedelta64[us]"), "v": rng.random(len(at))})


def test_asof_joins_do_not_meet_every_reading_of_an_hour(spark):
    rng = np.random.default_rng(4)
    left, right = dense(rng, 20_000, "t").drop(columns="v"), dense(rng, 20_000, "r")
    lefts, rights = spark.createDataFrame(left), spark.createDataFrame(right)
    for back_only, direction, f in ((False, "nearest", asof.nearest_asof), (True, "backward", asof.backward_asof)):
        assert "Join" not in plan(asof._asof(lefts, rights, "t", "r", [], 60, back_only))
        got = f(lefts, rights, left_on="t", right_on="r", tolerance_s=60, how="inner").toPandas().sort_values("t").reset_index(drop=True)
        want = pd.merge_asof(left, right, left_on="t", right_on="r", direction=direction, tolerance=pd.Timedelta("60s")).dropna().reset_index(drop=True)
        pd.testing.assert_frame_equal(got[["t", "r", "v"]], want[["t", "r", "v"]], check_dtype=False)


def test_asof_matches_no_null(spark):
    left = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), (None, dt.datetime(2024, 1, 1)), ("a", None)], "k string, t timestamp")
    right = spark.createDataFrame([(None, dt.datetime(2024, 1, 1), 1), ("a", None, 2)], "k string, r timestamp, v int")
    assert asof.nearest_asof(left, right, left_on="t", right_on="r", by=["k"]).count() == 0
    assert [r.v for r in asof.nearest_asof(left, right, left_on="t", right_on="r", by=["k"], how="left").collect()] == [None] * 3


def test_centred_median_takes_a_value_up_and_lets_it_go_once(spark):
    rng = np.random.default_rng(5)
    hours = np.sort(rng.choice(4000, 900, replace=False)) / 10
    values = [[None, float("inf"), -float("inf"), float(x)][min(int(k), 3)] for k, x in zip(rng.integers(0, 40, 900), rng.integers(0, 50, 900), strict=True)]
    rows = [(str(i % 2), dt.datetime(2024, 1, 1) + dt.timedelta(hours=float(h)), v) for i, (h, v) in enumerate(zip(hours, values, strict=True))]
    df = history.centred_median(spark.createDataFrame(rows, "k string, ts timestamp, v double"), ["k"], 5, "m")
    assert "Window" not in plan(df) and df.columns == ["k", "ts", "v", "m"]
    got = {(r.k, r.ts): r.m for r in df.collect()}
    assert len(got) == len(rows)
    half = dt.timedelta(hours=2.5)
    for k, t, _ in rows:
        near = sorted(v for g, u, v in rows if g == k and t - half < u <= t + half and v is not None)
        n = len(near)
        low, high = (near[(n - 1) // 2], near[n // 2]) if n else (None, None)
        assert got[k, t] == (None if n < 3 else low if low == high else 0.5 * low + 0.5 * high)


def test_the_newest_value_ties_with_itself_in_its_pool(spark):
    """Means that differ in their last bits from one branch to the next, as sums taken in another order do."""
    shaken = F.udf(lambda v: v * (1 + random.SystemRandom().randrange(-8, 9) * 2.0**-52), "double").asNondeterministic()
    days = spark.sql("SELECT 'all' AS location, explode(sequence(date'1996-01-01', date'2016-03-01')) AS day").withColumn("v", 40 + F.pmod(F.xxhash64("day"), F.lit(1009)) / 10)
    want = reports.modelled_snowpack(days, 2016, (1996, 2019))["summary"].first()
    for _ in range(3):
        got = reports.modelled_snowpack(days.withColumn("v", shaken("v")), 2016, (1996, 2019))["summary"].first()
        assert got.day == want.day and abs(got.percentile - want.percentile) < 1e-9
