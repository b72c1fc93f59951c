"""Long series: quality control, daily values, climatology, ranks, seasons, milestones."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.api.indexers import BaseIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nimbora.functions import scalar
from nimbora.functions import time as ft
from nimbora.operators import ranks
from nimbora.operators.asof import in_buckets

#: Limits of each variable; hours of its spike filter's window, and the largest jump from the window's median.
QC_RANGE = {"temperature_2m": (-45.0, 40.0), "snow_depth": (-0.3, 6.0)}
QC_SPIKE = {"temperature_2m": (5, 10.0), "snow_depth": (13, 0.5)}
SNOW_NOISE_M = 0.05
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
MID_MONTH = (15, 46, 74, 105, 135, 166, 196, 227, 258, 288, 319, 349)


def centred_median(df: DataFrame, by: Sequence[str], hours: float, out: str, min_n: int = 3) -> DataFrame:
    """Median of the values within half the window on either side, its left end left out.

    A bucket of time a few windows wide is one task's group, in which each value enters an ordered window once and leaves it once,
    so the work grows with the rows and not with the rows times those of a window.
    """
    half = int(hours * 1_800_000_000)
    plain = df.schema
    df = in_buckets(df, F.unix_micros("ts"), 16 * half, half - 1, half).withColumns({"__at": F.unix_micros("ts"), "__x": F.col("v").cast("double")})

    def medians(group: pa.Table) -> pa.Table:
        group = group.sort_by("__at")
        at, known = group["__at"].to_numpy(), group["__x"].is_valid().to_numpy(zero_copy_only=False)
        first, last = np.searchsorted(at, at - half, "right"), np.searchsorted(at, at + half, "right")
        values, place = np.unique(group["__x"].to_numpy()[known], return_inverse=True)  # places instead of values, since a rolling window takes neither NaN nor infinity for values
        rows = np.full(len(at), np.nan)
        rows[known] = place
        count = np.concatenate([[0], np.cumsum(known)])
        enough = count[last] - count[first] >= max(min_n, 1)
        rolled = pd.Series(rows).rolling(_Frames(first, last), min_periods=1)
        low, high = (values[rolled.quantile(0.5, interpolation=side).to_numpy()[enough].astype(int)] for side in ("lower", "higher"))
        found = np.zeros(len(at))
        found[enough] = np.where(low == high, low, 0.5 * low + 0.5 * high)
        own = group["__own"].to_numpy(zero_copy_only=False)
        return group.select(plain.names).append_column(out, pa.array(found, mask=~enough)).filter(pa.array(own))

    schema = T.StructType([*plain.fields, T.StructField(out, T.DoubleType())])
    return df.groupBy(*by, "__b").applyInArrow(medians, schema)


class _Frames(BaseIndexer):
    """A window for each row, from its first row to before its last."""

    def __init__(self, first: np.ndarray, last: np.ndarray) -> None:
        super().__init__()
        self.first, self.last = first.astype(np.int64), last.astype(np.int64)

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None) -> tuple[np.ndarray, np.ndarray]:
        return self.first, self.last


def qc_hourly(df: DataFrame, by: Sequence[str] = ("location",), limits: tuple[float, float] = QC_RANGE["temperature_2m"], spike: tuple[float, float] = QC_SPIKE["temperature_2m"], noise_floor: float | None = None, order: Sequence[str] = ()) -> DataFrame:
    """(by, ts, v) without values out of range and single spikes; of rows with one time the last by `order` stays.

    A value without enough neighbours for a median stays. Values below noise_floor become 0.
    """
    df = df.where(F.col("v").isNotNull() & ~F.isnan("v"))
    df = df.groupBy(*by, "ts").agg((F.max_by("v", F.struct(*order)) if order else F.max("v")).alias("v"))
    df = df.where(F.col("v").between(*[F.lit(x) for x in limits]))
    df = centred_median(df, by, spike[0], "__m").where(F.col("__m").isNull() | (F.abs(F.col("v") - F.col("__m")) <= spike[1])).drop("__m")
    return df.withColumn("v", F.when(F.col("v") < noise_floor, 0.0).otherwise(F.col("v"))) if noise_floor is not None else df


def daily_values(df: DataFrame, by: Sequence[str] = ("location",), how: str = "mean", min_count: int = 20, tz: str = ft.LOCAL_TZ) -> DataFrame:
    """(by, day, v, n) by local day, for days with enough hours; `how` is mean or median."""
    agg = F.avg("v") if how == "mean" else F.median("v")
    return df.groupBy(*by, ft.local_day(F.col("ts"), tz).alias("day")).agg(agg.alias("v"), F.count("v").alias("n")).where(F.col("n") >= min_count)


def date_spine(df: DataFrame, by: Sequence[str]) -> DataFrame:
    ends = df.groupBy(*by).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return ends.select(*by, F.explode(F.sequence("a", "b")).alias("day"))


def running_mean(daily: DataFrame, by: Sequence[str] = ("location",), window: int = 7, min_valid: int = 5) -> DataFrame:
    """(by, day, v): mean of a day and the days before it, also on days without a value of their own."""
    df = date_spine(daily, by).join(daily.select(*by, "day", "v"), [*by, "day"], "left")
    df = in_buckets(df, F.unix_date("day"), max(16 * window, 366), window - 1, 0)
    w = Window.partitionBy(*by, "__b").orderBy(F.unix_date("day")).rangeBetween(-(window - 1), 0)
    df = df.withColumn("v", F.when(F.count("v").over(w) >= min_valid, F.avg("v").over(w))).where("__own and v is not null")
    return df.select(*by, "day", "v")


def season_long(daily: DataFrame, kind: str, by: Sequence[str] = ("location",)) -> DataFrame:
    """(by, season_year, pos, v): the season matrix in long form; of two days in one place the first."""
    df = daily.where(ft.in_season(F.col("day"), kind) & F.col("v").isNotNull())
    df = df.select(*by, ft.season_year(F.col("day"), kind).alias("season_year"), ft.season_position(F.col("day"), kind).alias("pos"), "day", "v")
    return df.groupBy(*by, "season_year", "pos").agg(F.min_by("v", "day").alias("v"))


def season_matrix(long: DataFrame, kind: str, by: Sequence[str] = ("location",)) -> DataFrame:
    """One row for each season with an array of its values by position, null where there is none."""
    n = ft.SEASON_DAYS[kind]
    g = long.groupBy(*by, "season_year").agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("m"))
    return g.select(*by, "season_year", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at("m", i)).alias("values"))


def doy_arrays(daily: DataFrame, years: tuple[int, int] | None, window: int = 7, by: Sequence[str] = ("location",)) -> DataFrame:
    """(by, doy, values): for each day of the year the values of the reference years within the window, round the year's end; None takes all years.

    Each value is shuffled once, to its own day of the year; a frame over the group's 365 days, with as many before and behind them as the window
    is wide, puts the neighbours' arrays together. A pool holds 2 * window + 1 days of each year.
    """
    df = daily.where(F.col("v").isNotNull())
    df = df if years is None else df.where(F.year("day").between(*[F.lit(y) for y in years]))
    days = df.groupBy(*by, ft.day_of_year(F.col("day")).alias("doy")).agg(F.collect_list("v").alias("own"))
    spine = (days.select(*by).distinct() if by else days.limit(1).select()).withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(365))))
    turns = F.explode(F.expr(f"filter(array(doy - 365, doy, doy + 365), p -> p between {1 - window} and {365 + window})"))
    ring = spine.join(days, [*by, "doy"], "left").withColumn("at", turns)
    w = Window.partitionBy(*by).orderBy("at").rangeBetween(-window, window)  # 365 rows and twice the window's width
    pool = F.flatten(F.collect_list(F.coalesce("own", F.array().cast("array<double>"))).over(w))
    return ring.withColumn("values", pool).where((F.col("at") == F.col("doy")) & (F.size("values") > 0)).select(*by, "doy", "values")


def doy_pools(daily: DataFrame, years: tuple[int, int], window: int = 7, by: Sequence[str] = ("location",)) -> DataFrame:
    """(by, doy, v): for each day of the year all values within the window in the reference years."""
    return doy_arrays(daily, years, window, by).select(*by, "doy", F.explode("values").alias("v"))


def doy_climatology(daily: DataFrame, years: tuple[int, int], window: int = 7, quantiles: Sequence[float] = QUANTILES, by: Sequence[str] = ("location",)) -> DataFrame:
    """(by, doy, q, n, n_years): exact quantiles of each day's pool."""
    total = daily.where(F.year("day").between(*[F.lit(y) for y in years]) & F.col("v").isNotNull()).groupBy(*by).agg(F.count_distinct(F.year("day")).alias("n_years"))
    pools = doy_arrays(daily, years, window, by).withColumn("values", F.sort_array("values"))
    q = F.array(*[scalar.sorted_quantile(F.col("values"), x) for x in quantiles])
    out = pools.select(*by, "doy", q.alias("q"), F.size("values").cast("long").alias("n"))
    return out.join(total, list(by)) if by else out.crossJoin(F.broadcast(total))  # one row


def day_percentiles(daily: DataFrame, rows: DataFrame, years: tuple[int, int], window: int = 7, by: Sequence[str] = ("location",)) -> DataFrame:
    """rows(by, day, v) plus pct: the share of the values around the same date in the reference years that lies below, ties as half.

    pct is null where the value is no finite number, or there is none to compare with. Each row meets its day's pool as one array.
    """
    pools = doy_arrays(daily, years, window, by).select(*by, F.col("doy").alias("__doy"), F.filter("values", lambda x: ~F.isnan(x)).alias("__pool"))
    df = rows.withColumn("__doy", ft.day_of_year(F.col("day"))).join(pools, [*by, "__doy"], "left")
    count = lambda test: F.size(F.filter("__pool", test))
    share = (count(lambda x: x < F.col("v")) + 0.5 * count(lambda x: x == F.col("v"))) * 100.0 / F.size("__pool")
    return df.select(*rows.columns, F.when(ranks.number("v") & (F.size("__pool") > 0), share).alias("pct"))


percentile_rank = ranks.percentile_rank
_number = ranks.number


def rank_among(df: DataFrame, by: Sequence[str], value: str = "v", descending: bool = True) -> DataFrame:
    """df plus rank and out_of among the finite numbers of its group, null for any other value; ties share the better rank."""
    group = [*by, "__number"]
    order = F.desc(value) if descending else F.asc(value)
    df = df.withColumn("__number", _number(value))
    only = lambda c: F.when(F.col("__number"), c)
    ranked = df.withColumns({"rank": only(F.rank().over(Window.partitionBy(*group).orderBy(order))), "out_of": only(F.count("*").over(Window.partitionBy(*group)))})
    return ranked.drop("__number")


def same_days_means(long: DataFrame, positions: DataFrame, by: Sequence[str] = ("location",), min_coverage: float = 0.8) -> DataFrame:
    """(by, season_year, v, n): each season's mean over the given positions, where it has enough of them.

    positions(pos) hold for every group, positions(by, pos) for each its own.
    """
    own = [c for c in by if c in positions.columns]
    need = positions.select(*own, "pos").distinct()
    total = need.groupBy(*own).agg(F.count("*").alias("need"))
    g = long.join(need, [*own, "pos"], "left_semi").groupBy(*by, "season_year").agg(F.avg("v").alias("v"), F.count("v").alias("n"))
    g = g.join(total, own) if own else g.crossJoin(F.broadcast(total))  # one row
    return g.where(F.col("n") >= min_coverage * F.col("need")).drop("need")


def monthly_offsets(model: DataFrame, station: DataFrame, by: Sequence[str] = ("location",), min_days: int = 10) -> DataFrame:
    """(by, month, offset, n): mean of station less model for all 12 months; months with few days get the overall mean."""
    both = _difference(model, station, by)
    every = both.groupBy(*by).agg(F.avg("d").alias("overall"))
    months = every.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    own = both.groupBy(*by, F.month("day").alias("month")).agg(F.avg("d").alias("offset"), F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return months.join(own, [*by, "month"], "left").select(*by, "month", F.when(n >= min_days, F.col("offset")).otherwise(F.col("overall")).alias("offset"), n.alias("n"))


def _difference(model: DataFrame, station: DataFrame, by: Sequence[str]) -> DataFrame:
    m = model.where("v is not null").select(*by, "day", F.col("v").alias("m"))
    s = station.where("v is not null").select(*by, "day", F.col("v").alias("s"))
    return s.join(m, [*by, "day"]).select(*by, "day", "m", "s", (F.col("s") - F.col("m")).alias("d"))


def apply_offsets(model: DataFrame, offsets: DataFrame, by: Sequence[str] = ("location",)) -> DataFrame:
    """The model's series with the offsets added, interpolated between mid-months round the year's end."""
    knots = offsets.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "offset"))), lambda x: x["offset"]).alias("k"))  # 12 values
    df = model.join(knots, list(by)) if by else model.crossJoin(knots)  # without groups one row
    days = F.array(*[F.lit(d) for d in MID_MONTH])
    doy = ft.day_of_year(F.col("day"))
    doy = F.when(doy < MID_MONTH[0], doy + 365).otherwise(doy)
    i = F.size(F.filter(days, lambda d: d <= doy)) - 1  # the knot at or before the day
    x0, x1 = F.get(days, i), F.coalesce(F.get(days, i + 1), F.lit(MID_MONTH[0] + 365))
    y0, y1 = F.get("k", i), F.coalesce(F.get("k", i + 1), F.get("k", F.lit(0)))
    return df.withColumn("v", F.col("v") + y0 + (y1 - y0) * (doy - x0) / (x1 - x0)).drop("k")


def season_means(daily: DataFrame, kind: str, by: Sequence[str] = ("location",), min_coverage: float = 0.9) -> DataFrame:
    """(by, year, v, n) of seasons, or calendar years, with enough of their days."""
    df = daily.where("v is not null")
    if kind != "year":
        df = df.where(ft.in_season(F.col("day"), kind))
    year = (F.year("day") if kind == "year" else ft.season_year(F.col("day"), kind)).alias("year")
    g = df.groupBy(*by, year).agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return g.where(F.col("n") >= min_coverage * ft.season_length(F.col("year"), kind))


def monthly_season_means(monthly: DataFrame, kind: str, by: Sequence[str] = ("location",)) -> DataFrame:
    """Season means of monthly means (`day` is the month's first), for seasons with every month."""
    df = monthly.where("v is not null")
    if kind != "year":
        df = df.where(ft.in_season(F.col("day"), kind))
    year = (F.year("day") if kind == "year" else ft.season_year(F.col("day"), kind)).alias("year")
    need = 12 if kind == "year" else ft.season_months(kind)
    return df.groupBy(*by, year).agg(F.avg("v").alias("v"), F.count("*").alias("n")).where(F.col("n") == need)


def window_means(daily: DataFrame, first: str, last: str, by: Sequence[str] = ("location",)) -> DataFrame:
    """(by, year, v): mean of the days whose month and day lie in [first, last], such as "03-25" to "04-07"."""
    return daily.where(F.date_format("day", "MM-dd").between(first, last)).groupBy(*by, F.year("day").alias("year")).agg(F.avg("v").alias("v"))


def season_band(long: DataFrame, kind: str, by: Sequence[str] = ("location",), spread: int = 3, min_seasons: int = 8, quantiles: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """(by, pos, q, seasons): quantiles of the values within `spread` positions, which end at the season's ends."""
    df = long.withColumn("__o", F.explode(F.sequence(F.lit(-spread), F.lit(spread)))).withColumn("pos", F.col("pos") + F.col("__o"))
    df = df.where(F.col("pos").between(0, ft.SEASON_DAYS[kind] - 1))
    q = F.percentile("v", F.array(*[F.lit(float(x)) for x in quantiles]))
    return df.groupBy(*by, "pos").agg(q.alias("q"), F.count_distinct("season_year").alias("seasons")).where(F.col("seasons") >= min_seasons)


def average_line(long: DataFrame, by: Sequence[str] = ("location",), min_seasons: int = 10) -> DataFrame:
    return long.groupBy(*by, "pos").agg(F.median("v").alias("v"), F.count("v").alias("seasons")).where(F.col("seasons") >= min_seasons)


def snow_milestones(daily: DataFrame, by: Sequence[str] = ("location",), threshold: float = 10.0, max_gap: int = 14) -> DataFrame:
    """(by, season_year, onset, peak, peak_day, meltout) of snow seasons, each null where the record can't tell.

    Onset: first day at the threshold, with a lower day before it. Melt-out: first day below it after the peak.
    Both need no gap over max_gap days before them. The peak needs 80 % of December to April without such a gap.
    """
    df = daily.where(F.col("v").isNotNull() & ft.in_season(F.col("day"), "snow")).select(*by, ft.season_year(F.col("day"), "snow").alias("season_year"), "day", "v")
    keys = [*by, "season_year"]
    in_order = Window.partitionBy(*keys).orderBy("day")
    cold = (F.month("day") >= 12) | (F.month("day") <= 4)
    gap = lambda day: F.coalesce(F.datediff(day, F.lag(day, 1).over(in_order)), F.lit(0))
    last_cold = F.last(F.when(cold, F.col("day")), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("gap", gap(F.col("day"))).withColumns({
        "widest": F.max("gap").over(in_order), "lower_before": F.max((F.col("v") < threshold).cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)),
        "cold_gap": F.when(cold, F.coalesce(F.datediff("day", last_cold), F.lit(0))), "cold": cold,
    })
    top = df.groupBy(*keys).agg(F.max_by("day", F.struct("v", -F.unix_date("day"))).alias("top_day"))
    df = df.join(top, keys)
    first = df.groupBy(*keys).agg(
        F.min_by(F.struct("day", "widest", "lower_before"), F.when(F.col("v") >= threshold, F.col("day"))).alias("on"),
        F.min_by(F.struct("day", "widest"), F.when((F.col("day") > F.col("top_day")) & (F.col("v") < threshold), F.col("day"))).alias("off"),
        F.max("v").alias("top"), F.first("top_day").alias("top_day"), F.count_if("cold").alias("n_cold"), F.max("cold_gap").alias("cold_gap"),
    )
    peak_ok = (F.col("n_cold") >= 0.8 * 151) & (F.col("cold_gap") <= max_gap)
    return first.select(
        *keys, F.when((F.col("on.widest") <= max_gap) & (F.col("on.lower_before") == 1), F.col("on.day")).alias("onset"), F.when(peak_ok, F.col("top")).alias("peak"),
        F.when(peak_ok, F.col("top_day")).alias("peak_day"), F.when(F.col("off.widest") <= max_gap, F.col("off.day")).alias("meltout"),
    )


def milestone_stats(milestones: DataFrame, by: Sequence[str] = ("location",), min_n: int = 4) -> DataFrame:
    """(by, milestone, median, min, max, n) of onset, peak day and melt-out as positions in the season."""
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("milestone"), ft.season_position(F.col(m), "snow").alias("pos")) for m in ("onset", "peak_day", "meltout")]))
    df = milestones.select(*by, stack.alias("s")).select(*by, "s.milestone", "s.pos").where("pos is not null")
    return df.groupBy(*by, "milestone").agg(F.median("pos").alias("median"), F.min("pos").alias("min"), F.max("pos").alias("max"), F.count("*").alias("n")).where(F.col("n") >= min_n)


def percent_of_median(daily: DataFrame, climatology: DataFrame, by: Sequence[str] = ("location",), least: float = 0.2, kind: str = "snow", from_pos: int = 61) -> DataFrame:
    """daily plus pct_of_median, null where the median is small or the season is young; climatology(by, doy, median)."""
    df = daily.withColumns({"doy": ft.day_of_year(F.col("day")), "pos": F.when(ft.in_season(F.col("day"), kind), ft.season_position(F.col("day"), kind))})
    df = df.join(climatology.select(*by, "doy", "median"), [*by, "doy"], "left")
    return df.withColumn("pct_of_median", F.when((F.col("median") >= least) & (F.col("pos") >= from_pos), F.col("v") / F.col("median") * 100))


def winter_index(index: DataFrame, season: str = "NDJ") -> DataFrame:
    """(year, anom) of each winter by the year it ends in, from index(season, year, anom)."""
    return index.where(F.col("season") == season).select((F.col("year") + 1).alias("year"), "anom")


def detrend(yearly: DataFrame, by: Sequence[str] = ("location",)) -> DataFrame:
    """(by, year, v): residuals from a straight line; series of fewer than three points as they are."""
    df = yearly.where("v is not null")
    line = df.groupBy(*by).agg(F.regr_slope("v", F.col("year").cast("double")).alias("__s"), F.regr_intercept("v", F.col("year").cast("double")).alias("__i"), F.count("*").alias("__n"))
    df = df.join(line, list(by)) if by else df.crossJoin(F.broadcast(line))  # one row
    return df.withColumn("v", F.when(F.col("__n") >= 3, F.col("v") - F.col("__i") - F.col("__s") * F.col("year")).otherwise(F.col("v"))).drop("__s", "__i", "__n")


def enso_composite(anomalies: DataFrame, winters: DataFrame, by: Sequence[str] = ("location",)) -> DataFrame:
    """(by, phase, ord, n, mean, above) for every phase, also those without a winter."""
    df = anomalies.join(winters.select("year", scalar.enso_class(F.col("anom")).alias("phase")), "year").where("phase is not null")
    got = df.groupBy(*by, "phase").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.count_if(F.col("v") > 0).alias("above"))
    phases = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(p).alias("phase")) for i, p in enumerate(scalar.ENSO_CLASSES)])).alias("p")
    every = anomalies.select(*by).distinct().select(*by, phases) if by else anomalies.sparkSession.range(1).select(phases)
    return every.select(*by, "p.ord", "p.phase").join(got, [*by, "phase"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "above": F.coalesce("above", F.lit(0))})


def deseasonalised(df: DataFrame, value: str, by: Sequence[str] = ("location",)) -> DataFrame:
    """df with its calendar month's mean taken off the value."""
    months = df.groupBy(*by, F.month("day").alias("__m")).agg(F.avg(value).alias("__mean"))
    return df.withColumn("__m", F.month("day")).join(months, [*by, "__m"]).withColumn(value, F.col(value) - F.col("__mean")).drop("__m", "__mean")


def adjusted_band_coverage(model: DataFrame, station: DataFrame, by: Sequence[str] = ("location",), window: int = 7, low: float = 0.1, high: float = 0.9, train: float = 0.7, smooth: int = 1) -> DataFrame:
    """(by, below, above, n_days): share of the later shared days outside the adjusted model's band; at least 120 shared days.

    Offsets are learned on the days before the cut, the band on the test years of the adjusted model.
    """
    if smooth > 1:
        model, station = running_mean(model, by, smooth), running_mean(station, by, smooth)
    both = _difference(model, station, by)
    spans = both.groupBy(*by).agg(F.count("*").alias("n")).where("n >= 120")
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("day")) - 1
    placed = both.select(*by, "day", nth.alias("nth")).join(spans, list(by))
    cut = placed.where(F.col("nth") == F.floor(F.col("n") * F.lit(train))).select(*by, F.col("day").alias("cut"))
    early = lambda df: df.join(cut, list(by)).where("day < cut").drop("cut")
    adjusted = apply_offsets(model, monthly_offsets(early(model), early(station), by), by)
    test = both.join(cut, list(by)).where("day >= cut")
    years = test.groupBy(*by).agg(F.min(F.year("day")).alias("y0"), F.max(F.year("day")).alias("y1"))
    pool = adjusted.join(years, list(by)).where(F.year("day").between(F.col("y0"), F.col("y1")) & F.col("v").isNotNull())
    pool = doy_arrays(pool.select(*by, "day", "v"), None, window, by).withColumn("values", F.sort_array("values"))
    q = pool.select(*by, "doy", F.array(scalar.sorted_quantile(F.col("values"), low), scalar.sorted_quantile(F.col("values"), high)).alias("q"))
    scored = test.withColumn("doy", ft.day_of_year(F.col("day"))).join(q, [*by, "doy"])
    share = lambda test: F.round(F.avg(test.cast("double")), 3)
    return scored.groupBy(*by).agg(share(F.col("s") < F.col("q")[0]).alias("below"), share(F.col("s") > F.col("q")[1]).alias("above"), F.count("*").alias("n_days"))


def mean_change(difference: DataFrame, cut: Column, by: Sequence[str] = ("location",), value: str = "d") -> DataFrame:
    """(by, before, after, step, n_before, n_after) of a deseasonalised difference at a date."""
    df = deseasonalised(difference, value, by)
    old = F.col("day") < cut
    return df.groupBy(*by).agg(F.avg(F.when(old, F.col(value))).alias("before"), F.avg(F.when(~old, F.col(value))).alias("after"), F.count_if(old).alias("n_before"), F.count_if(~old).alias("n_after")).withColumn("step", F.col("after") - F.col("before"))


difference = _difference
