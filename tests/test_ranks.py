"""Ranks and quantiles of groups that are dealt by ranges, against numpy."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbora.operators import blend, history, ranks
from nimbora.session import stored


def some_values(n=3000):
    """A third of all rows are one group's; values tie, and some are null, NaN or infinite."""
    r = random.Random(3)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{i % 40}"
        out.append((key, r.choice([None, float("nan"), float("inf"), -0.0, 0.0]) if r.random() < 0.02 else round(r.gauss(0, 3), 1 if i % 2 else 6)))
    return out


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 20])
def test_percentiles_of_split_groups(spark, size):
    refs, asked = some_values(), [(k, v, i) for i, (k, v) in enumerate(some_values(500))] + [("none", 1.0, 900), (None, 1.0, 901), ("hot", -99.0, 902), ("hot", 99.0, 903)]
    values = spark.createDataFrame(asked, "k string, v double, i int").repartition(5)
    got = {r.i: r.pct for r in ranks.percentile_rank(values, spark.createDataFrame(refs, "k string, ref double").repartition(4), ["k"], range_values=size).collect()}
    assert len(got) == len(asked)
    for k, v, i in asked:
        pool = np.array([x for kk, x in refs if kk == k and x is not None and np.isfinite(x)])
        want = None if v is None or not np.isfinite(v) or not len(pool) else ((pool < v).sum() + 0.5 * (pool == v).sum()) * 100.0 / len(pool)
        assert got[i] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_a_large_group_is_many_ranges(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"), F.rand(5).alias("__x"), F.lit(1).cast("long").alias("__n"))
    df = stored(df, "values")
    totals = ranks._totals(ranks._dealt(df, ranks._splits(df, ["k"], 100), ["k"]), ["k"]).where("k = 'hot'").collect()
    assert len(totals) > 50 and sum(r["__in"] for r in totals) == 10_000 and max(r["__in"] for r in totals) < 1500


def test_a_mean_over_shuffled_partitions_finds_its_rank(spark):
    """The asked value is an average whose last bit depends on the order of its rows; it must still meet its references."""
    r = random.Random(1)
    rows = [(y, r.uniform(0, 500)) for y in range(2000, 2012) for _ in range(400)]
    years = spark.createDataFrame(rows, "year int, x double").repartition(4).groupBy("year").agg(F.avg("x").alias("v")).withColumn("k", F.lit("a"))
    for y in (2003, 2007):
        got = ranks.percentile_rank(years.where(F.col("year") == y), years.where(F.col("year") != y).select("k", F.col("v").alias("ref")), ["k"]).collect()
        assert len(got) == 1 and got[0].pct is not None


@pytest.mark.parametrize("size", [1, 11, 1 << 20])
def test_quantiles_of_split_groups(spark, size):
    rows = [(k, v) for k, v in some_values() if v is None or not np.isnan(v)] + [(None, 4.0), (None, 6.0), ("nothing", None)]
    ps = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    got = {r.k: (r.q, r.n) for r in ranks.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(4), ["k"], "v", ps, size).collect()}
    keys = {k for k, v in rows if v is not None}
    assert set(got) == keys
    for k in keys:
        x = np.array([v for kk, v in rows if kk == k and v is not None])
        with np.errstate(invalid="ignore"):
            want = np.quantile(x, ps)
        fine = np.isfinite(want)
        assert got[k][1] == len(x) and np.allclose(np.array(got[k][0])[fine], want[fine])


def test_quantiles_without_keys_and_of_nothing(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    (row,) = ranks.quantiles(df, [], "v", [0.5, 0.95]).collect()
    assert (row.q, row.n) == ([5.0, 9.5], 11)
    assert ranks.quantiles(df.where("v > 99"), [], "v", [0.5]).count() == 0


def test_day_pools_by_hand(spark):
    r = random.Random(2)
    start = dt.date(1999, 1, 1)
    rows = [(p, start + dt.timedelta(d), round(r.gauss(0, 2), 2)) for p in "ab" for d in range(1461) if r.random() < 0.7]
    daily = spark.createDataFrame(rows, "location string, day date, v double").repartition(3)
    doy = lambda d: dt.date(2001, d.month, min(d.day, 28) if d.month == 2 else d.day).timetuple().tm_yday
    want = {}
    for p, d, v in rows:
        if d.year < 2002:
            for o in range(-7, 8):
                want.setdefault((p, (doy(d) + o - 1) % 365 + 1), []).append(v)
    got = {(x.location, x.doy): sorted(x["values"]) for x in history.doy_arrays(daily, (1999, 2001)).collect()}
    assert got == {k: sorted(v) for k, v in want.items()}
    asked = daily.where(F.year("day") == 2002).unionByName(spark.createDataFrame([("a", dt.date(2002, 5, 1), None), ("c", dt.date(2002, 5, 1), 1.0), ("a", dt.date(2002, 5, 1), float("nan"))], daily.schema))
    for x in history.day_percentiles(daily, asked, (1999, 2001)).collect():
        pool = np.array(want.get((x.location, doy(x.day)), []))
        ok = x.v is not None and np.isfinite(x.v) and len(pool)
        assert x.pct == (pytest.approx(((pool < x.v).sum() + 0.5 * (pool == x.v).sum()) * 100 / len(pool)) if ok else None)


@pytest.mark.parametrize("block", ["day", "week", "month"])
def test_walk_forward_learns_only_from_the_window_before(spark, block):
    r = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for m in "xyz":
        for d in range(60):
            for h in (3, 15):
                issued = t0 + dt.timedelta(days=d, hours=h)
                e = r.gauss(0, 2)
                rows.append(("a", m, issued, issued + dt.timedelta(hours=24), 1, 10 + e, 10.0, e, abs(e)))
    pairs = spark.createDataFrame(rows, "location string, model string, issued_at timestamp, valid_time timestamp, lead_day int, value double, observed double, error double, abs_error double").repartition(4)
    out = blend.trained_members(pairs, window_days=20, min_train=5, block=block)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    start = {"day": lambda d: d.replace(hour=0), "week": lambda d: (d - dt.timedelta(days=d.weekday())).replace(hour=0), "month": lambda d: d.replace(day=1, hour=0)}[block]
    part = {(x.model, x.issued_at): x.part_of_day for x in blend.with_part_of_day(pairs).collect()}
    got = {(x.model, x.issued_at): (x.bias, x.mae) for x in out.collect()}
    want = {}
    for _, m, issued, *_ in rows:
        b = start(issued)
        past = [e for _, mm, i, v, *_, e, _ in rows if mm == m and part[mm, i] == part[m, issued] and b - dt.timedelta(days=20) <= v < b]
        if len(past) >= 5:
            want[m, issued] = (pytest.approx(np.mean(past)), pytest.approx(np.mean(np.abs(past))))
    assert got == want and want
