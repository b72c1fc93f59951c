"""Rounds dealt to tasks give what one generator gives call after call."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from nimbora.operators import resampling, rounds, verification


@pytest.mark.parametrize("parts", [[(13, 2**31 + 7)], [(50, 1)], [(7, 2**30 + 3), (5, 3 * 2**29 + 1)], [(5, 1), (9, 12)], [(3, 5), (4, 1), (2, 2**31 + 1)]])
@pytest.mark.parametrize("step", [1, 77, 250, 400])
def test_draws_by_place_are_those_of_the_generator(parts, step):
    """Bounds just above a power of two throw up to half of the words away."""
    n, rng = 400, np.random.default_rng(3)
    want = [rng.integers(0, below, (n, size)) for size, below in parts]
    picks = rounds.Picks(3, n, parts)
    thrown = picks.thrown_away()
    for part, rows in enumerate(want):
        got = np.vstack([picks.rows(part, first, min(step, n - first), thrown) for first in range(0, n, step)])
        assert (got == rows).all()


@pytest.mark.parametrize("words", [1, 100])
def test_thrown_words_are_found_in_chunks(monkeypatch, words):
    whole = rounds.Picks(1, 50, [(5, 3 * 2**30)]).thrown_away()
    monkeypatch.setattr(rounds, "_WORDS", words)
    assert whole and rounds.Picks(1, 50, [(5, 3 * 2**30)]).thrown_away() == whole


def yearly(spark):
    rng = np.random.default_rng(5)
    rows = [(k, 1990 + y, float(rng.normal(y * 0.1, 1))) for k, n in (("a", 20), ("b", 8), ("c", 7), (None, 9)) for y in range(n)]
    return spark.createDataFrame(rows + [("a", 2050, None), ("b", None, 1.0)], "location string, year int, v double")


@pytest.mark.parametrize("block", [3, 9])
def test_sen_slope_range_for_any_number_of_tasks(spark, monkeypatch, block):
    """Short groups and rows without year or value don't count; a null key is a group; a block as long as its series takes no draw."""
    df = yearly(spark)
    data = df.toPandas().dropna(subset=["year", "v"])
    want = {}
    for key, rows in data.groupby("location", dropna=False):
        series = rows.sort_values("year")[["year", "v"]].to_numpy(float)
        n, width = len(series), min(block, len(series))
        if n < 8:
            continue
        first = np.random.default_rng(0).integers(0, n - width + 1, (300, -(-n // width)))
        slopes = []
        for starts in first:
            places = np.concatenate([np.arange(s, s + width) for s in starts])[:n]
            pairs = [(series[j] - series[i]) for a, i in enumerate(places) for j in places[a + 1 :]]
            slopes.append(np.median([v / y for y, v in pairs if y]))
        lo, hi = np.quantile(slopes, [0.05, 0.95])
        want[None if pd.isna(key) else key] = (round(lo * 10, 2), round(hi * 10, 2), n)
    for size in (7, 250, 1000):
        monkeypatch.setattr(rounds, "ROUNDS", size)
        got = {r.location: (r.lo, r.hi, r.n) for r in resampling.sen_slope_range(df, block=block, n_boot=300).collect()}
        assert got == want and len(got) == 3


def test_nothing_is_drawn_for_an_empty_table(spark):
    assert resampling.sen_slope_range(yearly(spark).limit(0)).collect() == []


def test_step_change_is_that_of_one_generator(spark):
    """The later side's months are drawn first, then the earlier side's go on in the same stream."""
    rng, start = np.random.default_rng(7), dt.date(2020, 1, 1)
    days = [start + dt.timedelta(i) for i in range(900)]
    gap = [float(rng.normal(0 if d < dt.date(2021, 7, 1) else 2, 1)) for d in days]
    station = spark.createDataFrame([("x", d, g) for d, g in zip(days, gap, strict=True)] + [("x", days[5], None)], "location string, day date, v double")
    model = spark.createDataFrame([("x", d, 0.0) for d in days], "location string, day date, v double")
    df = pd.DataFrame({"day": pd.to_datetime(days), "d": gap})
    df["d"] -= df.groupby(df.day.dt.month).d.transform("mean")
    one, late = np.random.default_rng(0), df.day >= "2021-07-01"

    def means(part):
        months = [m.d.to_numpy() for _, m in part.groupby(part.day.dt.to_period("M"))]
        picks = [one.integers(0, len(months), len(months)) for _ in range(2000)]
        return np.array([np.concatenate([months[i] for i in p]).mean() for p in picks])

    after = means(df[late])
    lo, hi = np.percentile(after - means(df[~late]), [5, 95])
    r = resampling.step_change(station, model, "2021-07-01").first()
    assert (r.lo, r.hi) == (round(lo, 2), round(hi, 2)) and (r.n_before, r.n_after) == (int((~late).sum()), int(late.sum()))
    assert resampling.step_change(station, model, "2019-07-01").count() == 0  # no day before


def test_compare_models_is_compare_days(spark):
    rng, rows = np.random.default_rng(2), []
    for model, spread in (("m1", 1.0), ("m2", 1.3), ("m3", 2.0)):
        for day in range(25):
            for hour in (6, 18):
                t = dt.datetime(2024, 1, 1, hour) + dt.timedelta(day)
                rows.append(("x", 1, model, t - dt.timedelta(1), t, float(abs(rng.normal(0, spread)))))
    pairs = spark.createDataFrame(rows, "location string, lead_day int, model string, issued_at timestamp, valid_time timestamp, abs_error double")
    days = verification.paired_days(pairs, ["location", "lead_day"]).toPandas()
    got = verification.compare_models(pairs, ["location", "lead_day"]).toPandas()
    assert len(got) == 2
    for r in got.itertuples():
        want = verification.compare_days(days[days.model == r.model])
        assert all(getattr(r, k) == pytest.approx(v, rel=1e-12) for k, v in want.items())
