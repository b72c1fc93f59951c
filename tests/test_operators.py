"""Operators against brute force and against stated cases."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nimbora.functions import scalar
from nimbora.functions import time as ft
from nimbora.operators import asof, blend, ensemble, history, resampling, series, verification

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_nearest_asof_equals_pandas(spark):
    rng = np.random.default_rng(1)
    left = pd.DataFrame({"k": rng.choice(["a", "b"], 400), "t": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 400_000, 400), unit="s")}).sort_values("t")
    right = pd.DataFrame({"k": rng.choice(["a", "b"], 300), "r": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 400_000, 300), unit="s"), "v": rng.random(300)}).drop_duplicates(["k", "r"]).sort_values("r")
    want = pd.merge_asof(left, right, left_on="t", right_on="r", by="k", direction="nearest", tolerance=pd.Timedelta("30min")).dropna()
    got = asof.nearest_asof(spark.createDataFrame(left), spark.createDataFrame(right), left_on="t", right_on="r", by=["k"]).toPandas()
    columns = ["k", "t", "r", "v"]
    pd.testing.assert_frame_equal(got[columns].sort_values(columns).reset_index(drop=True), want[columns].sort_values(columns).reset_index(drop=True), check_dtype=False)


def test_nearest_asof_tie_takes_the_earlier_and_keeps_the_tolerance(spark):
    left = frame(spark, [(at(1),), (at(5),)], "t timestamp")
    right = frame(spark, [(at(0.5), 1.0), (at(1.5), 2.0), (at(5.6), 3.0)], "r timestamp, v double")
    assert [(r.t, r.v) for r in asof.nearest_asof(left, right, left_on="t", right_on="r").collect()] == [(at(1), 1.0)]


def test_backward_asof_allows_the_same_time_and_nothing_later(spark):
    left = frame(spark, [(at(1),), (at(2),), (at(9),)], "t timestamp")
    right = frame(spark, [(at(1), 1.0), (at(1.6), 2.0), (at(2.1), 3.0)], "r timestamp, v double")
    got = {r.t: r.v for r in asof.backward_asof(left, right, left_on="t", right_on="r").collect()}
    assert got == {at(1): 1.0, at(2): 2.0, at(9): None}


def test_trailing_mean_is_causal(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 2)), at(int(h)), at(int(h) - int(rng.integers(1, 60))), float(rng.normal())) for h in rng.integers(0, 1500, 200)]
    got = asof.trailing_mean(frame(spark, rows, "k int, happened timestamp, asked timestamp, v double"), value="v", happened="happened", asked="asked", by=["k"], window_days=10, min_n=3, out="m").collect()
    assert len(got) == len(rows)
    for r in got:
        before = [v for k, h, _, v in rows if k == r.k and r.asked - dt.timedelta(days=10) <= h < r.asked]
        assert (r.m is None) if len(before) < 3 else math.isclose(r.m, np.mean(before), abs_tol=1e-9)


def test_lead_day_rounds_halves_to_even(spark):
    rows = [(at(0), at(h)) for h in (12, 34, 36, 60)]
    got = frame(spark, rows, "a timestamp, b timestamp").select(ft.lead_day(F.col("b"), F.col("a"))).collect()
    assert [r[0] for r in got] == [0, 1, 2, 2]


def test_local_to_utc_drops_skipped_and_doubled_times(spark):
    rows = [(dt.datetime(2024, 3, 10, 2, 30),), (dt.datetime(2024, 11, 3, 1, 30),), (dt.datetime(2024, 7, 1, 5, 0),)]
    got = [r[0] for r in frame(spark, rows, "t timestamp").select(ft.local_to_utc(F.col("t"))).collect()]
    assert got == [None, None, dt.datetime(2024, 7, 1, 12, 0)]


def test_season_calendar(spark):
    days = [dt.date(2024, 2, 29), dt.date(2023, 11, 1), dt.date(2024, 4, 30)]
    df = frame(spark, [(d,) for d in days], "day date")
    got = df.select(ft.season_position(F.col("day"), "winter").alias("p"), ft.season_year(F.col("day"), "winter").alias("y"), ft.day_of_year(F.col("day")).alias("d"), ft.season_label(F.lit(2027), "snow").alias("l")).collect()
    assert [(r.p, r.y, r.d) for r in got] == [(119, 2024, 59), (0, 2024, 305), (180, 2024, 120)]
    assert got[0].l == "2026–27"
    assert [len(df.limit(1).select(ft.season_axis(k)).first()[0]) for k in ("winter", "summer", "snow")] == [181, 184, 273]


FC = "location string, model string, issued_at timestamp, valid_time timestamp, value double, source string"
OB = "location string, time timestamp, value double"


def test_align_drops_unmatched_and_hindcast(spark):
    fc = frame(spark, [("a", "m", at(0), at(36), 5.0, "live"), ("a", "m", at(0), at(40), 5.0, "live"), ("a", "m", at(37), at(36), 5.0, "live"), ("b", "m", at(0), at(36), 5.0, "live")], FC)
    got = verification.align(fc, frame(spark, [("a", at(36.3), 3.0)], OB)).collect()
    assert [(r.valid_time, r.error, r.lead_day) for r in got] == [(at(36), 2.0, 2)]


def test_align_of_nothing_is_nothing(spark):
    assert verification.align(frame(spark, [], FC), frame(spark, [], OB)).count() == 0


def pairs(spark, models, days=20):
    rows = []
    for m, errors in models.items():
        rows += [("a", m, at(24 * d), at(24 * d + h), abs(errors[(d * 24 + h) % len(errors)]), errors[(d * 24 + h) % len(errors)], 1) for d in range(days) for h in range(24)]
    return frame(spark, rows, "location string, model string, issued_at timestamp, valid_time timestamp, abs_error double, error double, lead_day int")


def test_clear_winner_and_tie(spark):
    r = verification.winners_by_lead(pairs(spark, {"good": [0.5, -0.4], "bad": [2.0, -2.2]})).first()
    assert (r.model, r.decisive, r.tied, r.runner_up) == ("good", True, ["good"], "bad")
    r = verification.winners_by_lead(pairs(spark, {"x": [1.0, 3.0, 2.0, 0.5, 2.5], "y": [3.0, 0.5, 1.0, 2.5, 2.01]})).first()
    assert not r.decisive and r.tied == ["x", "y"]


def test_single_model_is_not_decisive(spark):
    r = verification.winners_by_lead(pairs(spark, {"only": [1.0]})).first()
    assert not r.decisive and r.runner_up is None


def test_compare_days_is_seeded():
    days = pd.DataFrame({"day": range(12), "a": np.arange(12.0) + 2, "b": np.arange(12.0), "n": 24})
    one, two = verification.compare_days(days), verification.compare_days(days.sample(frac=1, random_state=3))
    assert one == two and one["days"] == 12 and one["diff"] > 0


def test_run_init_table(spark):
    rows = [("a", "m", at(10), at(30), 1.0, "live", at(6)), ("a", "m", at(22), at(40), 1.0, "live", None), ("a", "m", at(25), at(40), 1.0, "previous_runs", None), ("a", "g_member03", at(7), at(40), 1.0, "live", None)]
    got = {(r.model, r.issued_at): (r.init_time, r.init_basis) for r in verification.add_run_init(frame(spark, rows, FC + ", run_init timestamp")).collect()}
    assert got == {("m", at(10)): (at(6), "logged"), ("m", at(22)): (at(18), "estimated"), ("m", at(25)): (at(24), "cycle"), ("g_member03", at(7)): (at(0), "estimated")}


def blend_pairs(spark, bias=4.0, days=60):
    rows = [("a", m, at(24 * d), at(24 * d + 24), 10 + b, 10.0, b, abs(b), 1) for d in range(days) for m, b in (("x", bias), ("y", -1.0))]
    return frame(spark, rows, "location string, model string, issued_at timestamp, valid_time timestamp, value double, observed double, error double, abs_error double, lead_day int")


def test_coefficients_use_only_what_came_before(spark):
    c = {r.model: (r.n, r.bias) for r in blend.learn_coefficients(blend_pairs(spark), F.lit("2024-01-15").cast("timestamp"), min_train=1).collect()}
    assert c == {"x": (13, 4.0), "y": (13, -1.0)}


def test_walk_forward_is_out_of_sample(spark):
    p = blend_pairs(spark)
    out = blend.walk_forward(p, min_train=10).collect()
    assert out and all(r.issued_at >= dt.datetime(2024, 2, 1) and abs(r.error) < 1e-9 for r in out)
    late = F.col("valid_time") >= F.lit("2024-02-01").cast("timestamp")
    changed = p.withColumn("observed", F.when(late, 99.0).otherwise(F.col("observed"))).withColumn("error", F.when(late, -50.0).otherwise(F.col("error")))
    february = lambda rows: sorted((r.valid_time, r.value) for r in rows if r.issued_at < dt.datetime(2024, 3, 1))
    assert february(blend.walk_forward(changed, min_train=10).collect()) == february(out)


def test_live_blend_weights(spark):
    coef = frame(spark, [("a", "x", 1, "Night", 0.0, 3.0), ("a", "y", 1, "Night", 2.0, 1.0)], "location string, model string, lead_day int, part_of_day string, bias double, weight double")
    rows = frame(spark, [("a", "x", at(10), 8.0, 1), ("a", "y", at(10), 10.0, 1)], "location string, model string, valid_time timestamp, value double, lead_day int")
    assert [(r.value, r.n_members) for r in blend.live_blend(rows, coef).collect()] == [(8.0, 2)]


def test_fair_crps_equals_the_full_matrix(spark):
    rng = np.random.default_rng(5)
    rows = [(list(map(float, rng.normal(size=int(n)))), float(rng.normal())) for n in rng.integers(15, 22, 30)] + [([2.0] * 20, 5.0)]
    got = frame(spark, rows, "x array<double>, y double").select(scalar.fair_crps(F.col("x"), F.col("y"))).collect()
    for (x, y), r in zip(rows, got, strict=True):
        x = np.array(x)
        n = len(x)
        assert math.isclose(r[0], np.abs(x - y).mean() - np.abs(x[:, None] - x).sum() / (2 * n * (n - 1)), abs_tol=1e-9)


def test_few_members_are_not_scored(spark):
    df = frame(spark, [([1.0] * 10, 1.0), ([1.0] * 16, 1.0)], "members array<double>, observed double")
    assert [r.n_members for r in ensemble.member_scores(df).collect()] == [16]


def test_qc_drops_sentinels_and_spikes(spark):
    values = [1.0, 1.2, 25.0, 1.1, 1.3, -6999.0, 1.2]
    df = frame(spark, [("a", at(i), v) for i, v in enumerate(values)], "location string, ts timestamp, v double")
    assert [r.v for r in history.qc_hourly(df).orderBy("ts").collect()] == [1.0, 1.2, 1.1, 1.3, 1.2]


def test_running_mean_needs_five_of_seven(spark):
    day = dt.date(2024, 1, 1)
    df = frame(spark, [("a", day + dt.timedelta(days=i), float(i)) for i in (0, 1, 2, 4, 5, 20)], "location string, day date, v double")
    got = {(r.day - day).days: r.v for r in history.running_mean(df).collect()}
    assert got == {5: 2.4, 6: 2.4}


def test_pools_wrap_round_new_year(spark):
    df = frame(spark, [("a", dt.date(2000, 12, 28), 1.0), ("a", dt.date(2001, 1, 3), 2.0), ("a", dt.date(2000, 6, 1), 3.0)], "location string, day date, v double")
    pools = history.doy_pools(df, (2000, 2001)).where("doy = 1").collect()
    assert sorted(r.v for r in pools) == [1.0, 2.0]


def season(start, end_melt, gap=()):
    days, out = [start + dt.timedelta(days=i) for i in range(270)], []
    for d in days:
        if d in gap:
            continue
        out.append(("a", d, float(max(0, 200 - abs((dt.date(2021, 3, 20) - d).days) * 1.5)) if d < end_melt else 0.0))
    return out


def test_snow_milestones(spark):
    rows = season(dt.date(2020, 10, 1), dt.date(2021, 5, 15))
    r = history.snow_milestones(frame(spark, rows, "location string, day date, v double")).first()
    assert (r.peak_day, r.peak, r.meltout) == (dt.date(2021, 3, 20), 200.0, dt.date(2021, 5, 15)) and r.onset is not None
    gap = {dt.date(2021, 1, 1) + dt.timedelta(days=i) for i in range(60)}
    r = history.snow_milestones(frame(spark, [x for x in rows if x[1] not in gap], "location string, day date, v double")).first()
    assert (r.peak, r.meltout) == (None, None) and r.onset is not None
    late = [x for x in rows if x[1] >= dt.date(2021, 1, 20)]
    assert history.snow_milestones(frame(spark, late, "location string, day date, v double")).first().onset is None


def test_offsets_and_interpolation(spark):
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(731)]
    model = frame(spark, [("a", d, 0.0) for d in days], "location string, day date, v double")
    station = frame(spark, [("a", d, float(d.month)) for d in days], "location string, day date, v double")
    off = history.monthly_offsets(model, station)
    assert {r.month: r.offset for r in off.collect()} == {m: float(m) for m in range(1, 13)}
    got = {r.day: r.v for r in history.apply_offsets(model, off).collect()}
    knots = [15, 46, 74, 105, 135, 166, 196, 227, 258, 288, 319, 349]
    for d in days[::13]:
        doy = min(d.timetuple().tm_yday - (d.year == 2000 and d.month > 2), 365)
        assert math.isclose(got[d], np.interp(doy, knots, range(1, 13), period=365), abs_tol=1e-9)


def test_step_change_finds_a_planted_step(spark):
    rng = np.random.default_rng(0)
    days = [dt.date(2019, 1, 1) + dt.timedelta(days=i) for i in range(1800)]
    model = frame(spark, [("a", d, 0.0) for d in days], "location string, day date, v double")
    station = frame(spark, [("a", d, float(rng.normal(0, 0.2)) - (0.6 if d >= dt.date(2021, 10, 15) else 0)) for d in days], "location string, day date, v double")
    r = resampling.step_change(station, model, "2021-10-15", n_boot=300).first()
    assert r.lo <= r.step <= r.hi < 0


def test_sen_slope_and_statement(spark):
    rows = [("a", y, 0.03 * y) for y in range(1980, 2020)] + [("short", 2000 + i, 1.0) for i in range(7)]
    df = frame(spark, rows, "location string, year int, v double")
    assert [(r.location, round(r.slope, 6)) for r in resampling.sen_slope(df).collect()] == [("a", 0.3)]
    ranges = resampling.sen_slope_range(df, n_boot=50)
    assert [r.location for r in ranges.collect()] == ["a"]
    assert resampling.trend_statement(ranges).first().verdict == "warming"


def test_permutation_needs_three_values(spark):
    rows = [("a", i, float(i % 2) * 5 + i * 0.01, i % 2 == 1) for i in range(20)] + [("b", 1, 1.0, True)]
    got = resampling.permutation_test(frame(spark, rows, "location string, year int, v double, in_a boolean"), n_perm=200).collect()
    assert [r.location for r in got] == ["a"] and got[0].p < 0.05


@pytest.mark.parametrize(("bottom", "top", "want"), [(2.0, -2.0, (945.0, "interp")), (8.0, 5.0, (1833.33, "above")), (-3.0, -7.0, (432.5, "below")), (-4.0, -1.0, (None, "inversion"))])
def test_freezing_level(spark, bottom, top, want):
    h, _, _, regime = scalar.freezing_level(F.lit(bottom), F.lit(top))
    r = spark.range(1).select(F.round(h, 2).alias("h"), regime.alias("r")).first()
    assert (r.h, r.r) == want


def test_labels(spark):
    r = spark.range(1).select(
        scalar.temperature_bin(F.lit(None).cast("double")), scalar.temperature_bin(F.lit(-10.0)), scalar.enso_class(F.lit(0.5)), scalar.enso_class(F.lit(-1.0)),
        scalar.ordinal(F.lit(112)), scalar.ordinal(F.lit(23)), scalar.signed(F.lit(1.25)), scalar.base_model(F.lit("geps_member07")), scalar.compass(F.lit(350.0)), scalar.percentile_class(F.lit(10.0)),
    ).first()
    assert tuple(r) == ("nan", "≤ −10", "weak El Niño", "moderate/strong La Niña", "112th", "23rd", "+1.3" if r[6] == "+1.3" else "+1.2", "geps", "N", "below")


def test_hours_between_readings(spark):
    df = frame(spark, [("a", at(0.5), 0.0), ("a", at(1.5), 10.0), ("a", at(4), 20.0)], "location string, ts timestamp, v double")
    assert [(r.ts, r.v) for r in series.to_whole_hours(df).collect()] == [(at(1), 5.0)]


def test_content_equality(spark):
    a = spark.range(5)
    assert series.same_content(a, spark.range(5)) and not series.same_content(a, spark.range(4))


def test_percentile_rank_of_odd_values(spark):
    """Nulls, NaN and rows without a pool stay without a percentile; equal rows stay apart; NaN is no reference."""
    nan = float("nan")
    values = frame(spark, [("a", 1, 2.0), ("a", 2, 2.0), ("a", 2, 2.0), ("a", 3, None), ("a", 4, nan), ("b", 5, 1.0), ("a", 6, 9.0), ("a", 7, -1.0), ("a", 8, 2.5), (None, 9, 1.0)], "k string, i int, v double")
    refs = frame(spark, [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 3.0), ("a", nan), ("a", None), ("c", 1.0)], "k string, ref double")
    got = sorted((r.i, r.pct) for r in history.percentile_rank(values, refs, ["k"]).collect())
    assert got == [(1, 50.0), (2, 50.0), (2, 50.0), (3, None), (4, None), (5, None), (6, 100.0), (7, 0.0), (8, 75.0), (9, None)]


def test_rank_leaves_out_what_is_no_number(spark):
    df = frame(spark, [("a", 1, 3.0), ("a", 2, float("nan")), ("a", 3, None), ("a", 4, 5.0), ("a", 5, 3.0), ("b", 6, None)], "k string, i int, v double")
    got = {r.i: (r["rank"], r.out_of) for r in history.rank_among(df, ["k"]).collect()}
    assert got == {4: (1, 3), 1: (2, 3), 5: (2, 3), 2: (None, None), 3: (None, None), 6: (None, None)}


def test_statement_of_nothing_is_unknown(spark):
    schema = "k string, slope double, lo double, hi double"
    got = resampling.trend_statement(frame(spark, [], schema)).first()
    assert (got.verdict, got.min_slope, got.n_sources) == ("unknown", None, 0)
    rows = [("up", 0.3, 0.1, 0.5), ("up", 0.2, 0.1, 0.4), ("down", -0.3, -0.5, -0.1), ("mixed", 0.3, 0.1, 0.5), ("mixed", 0.1, -0.1, 0.4), ("none", None, None, None), ("one", 0.2, 0.1, 0.3), ("one", None, None, None)]
    got = {r.k: (r.verdict, r.n_sources) for r in resampling.trend_statement(frame(spark, rows, schema), ["k"]).collect()}
    assert got == {"up": ("warming", 2), "down": ("cooling", 1), "mixed": ("no clear trend", 2), "none": ("unknown", 0), "one": ("warming", 1)}


def test_small_cells_are_compared_when_asked(spark):
    """With a smaller min_n, models of 12 rows compare too, and the best is the ranking's best."""
    rows = [("a", m, at(24 * d), at(24 * d + 12), e + 0.01 * (d % 3)) for m, e in (("x", 0.5), ("y", 2.0), ("z", 3.0)) for d in range(12)]
    pairs = frame(spark, rows, "location string, model string, issued_at timestamp, valid_time timestamp, abs_error double")
    got = verification.rank_with_ties(pairs, ["location"], min_n=5).first()
    assert (got.model, got.runner_up, got.tied, got.decisive) == ("x", "y", ["x"], True) and abs(got.margin - 1.5) < 1e-9
    assert verification.rank_with_ties(pairs, ["location"]).count() == 0


def test_rounds_are_those_of_one_draw_after_another():
    """Matrices of draws give the numbers that draws one by one give."""
    rng, seeds = np.random.default_rng(0), np.random.default_rng(0)
    assert (rng.integers(0, 7, (50, 5)) == [seeds.choice(np.arange(7), 5) for _ in range(50)]).all()
    rng, seeds, x = np.random.default_rng(0), np.random.default_rng(0), np.arange(12) / 7
    assert (rng.permuted(np.broadcast_to(x, (50, 12)), axis=1) == [seeds.permutation(x) for _ in range(50)]).all()


def test_median_slopes():
    rng = np.random.default_rng(3)
    many = np.stack([np.sort(rng.integers(1950, 1970, (6, 12)), axis=1).astype(float), rng.normal(size=(6, 12))], axis=-1)
    for one, got in zip(many, resampling.median_slopes(many), strict=True):
        slopes = [(b[1] - a[1]) / (b[0] - a[0]) for i, a in enumerate(one) for b in one[i + 1 :] if a[0] != b[0]]
        assert got == np.median(slopes)


def test_sweep_equals_single_walks(spark):
    """One pass over all weightings gives what a walk for each gives."""
    rng = np.random.default_rng(5)
    rows = [("a", m, at(24 * d), at(24 * d + h), float(v), 0.0, float(v), abs(float(v)), 0) for d in range(60) for h in (1, 7) for m, v in zip("wxyz", rng.normal([1, 2, -1, 0.2], 0.5), strict=True) if rng.random() < 0.8]
    pairs = frame(spark, rows, "location string, model string, issued_at timestamp, valid_time timestamp, value double, observed double, error double, abs_error double, lead_day int")
    walk = {"window_days": 20, "min_train": 3, "block": "week"}
    got = {r.scheme: (r.n, round(r.mae, 9)) for r in blend.weighting_sweep(pairs, **walk).collect()}
    for name, options in {"equal": {"weight": blend.WEIGHTINGS["equal"]}, "1/mae^2": {}, "top-3": {"weight": blend.inverse_power(1.0), "top_n": 3}, "best-1": {"top_n": 1, "min_members": 1}}.items():
        one = blend.walk_forward(pairs, **walk, **options).agg(F.count("*"), F.avg("abs_error")).first()
        assert got[name] == (one[0], round(one[1], 9))
    regimes = blend.regime_sweep(pairs, **walk).groupBy("regime").count().collect()
    assert {r.regime: r["count"] for r in regimes} == dict.fromkeys(blend.REGIMES, 7)
