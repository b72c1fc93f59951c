"""Series for display and exchange: gaps, hourly interpolation, daily tables, grids, frames, freezing level."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbora.functions import scalar
from nimbora.functions import time as ft
from nimbora.operators.asof import in_buckets, nearest_asof


BUCKET_US = 7 * 86_400_000_000  # of time within which readings are put in order


def islands(df: DataFrame, by: Sequence[str], ts: str = "ts", gap_s: int = 3660, out: str = "island") -> DataFrame:
    """df plus the number of the run it lies in; a gap over gap_s starts a new one.

    Readings are put in order within weeks, each of which also sees what came shortly before it. The runs that begin
    in a week are counted, and the numbers of a group's weeks are summed up, one row a week.
    """
    gap, t = gap_s * 1_000_000, F.unix_micros(ts)
    seen = in_buckets(df, t, BUCKET_US, gap, 0)
    w = Window.partitionBy(*by, "__b").orderBy(ts)
    starts = F.coalesce(t - F.unix_micros(F.lag(ts).over(w)) > gap, F.lit(True))
    seen = seen.withColumn("__new", starts.cast("int")).where("__own").withColumn("__k", F.sum("__new").over(w))
    weeks = seen.groupBy(*by, "__b").agg(F.sum("__new").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__b")) - F.col("__n")
    weeks = weeks.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], F.col("__b").alias("__w"), before.alias("__before"))
    same = (F.col("__b") == F.col("__w")) & reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)], F.lit(True))
    return seen.join(weeks, same).select(*df.columns, (F.col("__k") + F.col("__before")).alias(out))


def smooth_in_islands(df: DataFrame, by: Sequence[str], value: str = "v", ts: str = "ts", out: str = "smooth", gap_s: int = 3660) -> DataFrame:
    """Median of three within each run; a week also sees the readings of a run that lie a gap at most before and after it."""
    gap = gap_s * 1_000_000
    runs = in_buckets(islands(df, by, ts, gap_s), F.unix_micros(ts), BUCKET_US, gap, gap)
    w = Window.partitionBy(*by, "island", "__b").orderBy(ts).rowsBetween(-1, 1)
    return runs.withColumn(out, F.percentile(value, F.lit(0.5)).over(w)).where("__own").drop("__b", "__own")


def to_whole_hours(df: DataFrame, by: Sequence[str] = ("location",), max_gap_s: int = 5400) -> DataFrame:
    """(by, ts, v) at whole hours by straight lines between readings at most max_gap_s apart."""
    seen = in_buckets(df.where("v is not null").select(*by, "ts", "v"), F.unix_micros("ts"), BUCKET_US, 0, max_gap_s * 1_000_000)
    w = Window.partitionBy(*by, "__b").orderBy("ts")
    df = seen.select(*by, "ts", "v", "__own", F.lead("ts").over(w).alias("t1"), F.lead("v").over(w).alias("v1")).where("__own")
    t0, t1 = F.unix_micros("ts") / 1e6, F.unix_micros("t1") / 1e6
    first, last = F.ceil(t0 / 3600), F.floor(t1 / 3600)
    hours = F.when((t1 - t0 <= max_gap_s) & (first <= last), F.sequence(first, last))
    df = df.select(*by, "v", "v1", t0.alias("t0"), t1.alias("t1"), F.explode(hours).alias("h"))
    at = F.col("h") * 3600
    line = F.when(F.col("t1") == F.col("t0"), F.col("v")).otherwise(F.col("v") + (F.col("v1") - F.col("v")) * (at - F.col("t0")) / F.nullif(F.col("t1") - F.col("t0"), F.lit(0.0)))
    return df.select(*by, F.timestamp_seconds(at).alias("ts"), line.alias("v")).groupBy(*by, "ts").agg(F.min("v").alias("v"))


def append_newer(old: DataFrame, new: DataFrame, by: Sequence[str] = ("location",)) -> DataFrame:
    """old with those rows of new that are later than anything old has in their group; of equal times one stays."""
    last = old.groupBy(*by).agg(F.max("ts").alias("__last"))
    fresh = new.join(last, list(by), "left").where(F.col("__last").isNull() | (F.col("ts") > F.col("__last"))).drop("__last")
    return old.unionByName(fresh.dropDuplicates([*by, "ts"]))


def daily_table(df: DataFrame, by: Sequence[str] = ("model",), tz: str = ft.LOCAL_TZ) -> DataFrame:
    """(by, day, low, high, mean, total, n) of each local day."""
    return df.groupBy(*by, ft.local_day(F.col("ts"), tz).alias("day")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.sum("v").alias("total"), F.count("v").alias("n"))


def wind_table(df: DataFrame, by: Sequence[str] = ("model",), tz: str = ft.LOCAL_TZ) -> DataFrame:
    """(by, day, direction, compass): circular mean direction of each local day."""
    out = df.groupBy(*by, ft.local_day(F.col("ts"), tz).alias("day")).agg(scalar.circular_mean(F.col("degrees")).alias("direction"))
    return out.withColumn("compass", scalar.compass(F.col("direction")))


def stripes(yearly: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """yearly(year, v) plus shade, -1 to 1: the anomaly over twice the root mean square of all."""
    scale = yearly.groupBy(*by).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("__rms"))
    df = yearly.join(scale, list(by)) if by else yearly.crossJoin(F.broadcast(scale))  # one row
    return df.withColumn("shade", F.when(F.col("__rms") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("v") / (2 * F.col("__rms"))))).otherwise(0.0)).drop("__rms")


def align_on_times(df: DataFrame, series: Sequence[str] = ("model",), by: Sequence[str] = ("location",)) -> DataFrame:
    """Every series of a group on all times of the group, null where it has no value."""
    times = df.select(*by, "valid_time").distinct()
    names = df.select(*by, *series).distinct()
    return times.join(names, list(by)).join(df.select(*by, *series, "valid_time", "value"), [*by, *series, "valid_time"], "left")


def as_arrays(grid: DataFrame, series: Sequence[str] = ("model",), by: Sequence[str] = ("location",)) -> DataFrame:
    """(by, series, times, values): aligned series as arrays in the order of time."""
    rows = F.array_sort(F.collect_list(F.struct("valid_time", "value")))
    g = grid.groupBy(*by, *series).agg(rows.alias("r"))
    return g.select(*by, *series, F.transform("r", lambda x: ft.iso_minute(x["valid_time"])).alias("times"), F.transform("r", lambda x: x["value"]).alias("values"))


def thin_frames(frames: DataFrame, now: Column, recent_days: int = 30, hour_utc: int = 20, by: Sequence[str] = ("camera",)) -> DataFrame:
    """All frames of the recent days; of every earlier day the one nearest to an hour, of equals the newer."""
    recent = F.unix_seconds("time") >= F.unix_seconds(now) - recent_days * 86_400
    minutes = F.hour("time") * 60 + F.minute("time")
    w = Window.partitionBy(*by, F.to_date("time")).orderBy(F.abs(minutes - hour_utc * 60), F.desc("time"))
    old = frames.where(~recent).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    return frames.where(recent).unionByName(old)


def latest_frames(frames: DataFrame, most: int, by: Sequence[str] = ("camera",)) -> DataFrame:
    """The newest `most` frames of each camera."""
    newest = lambda df, keys: df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("time")))).where(F.col("__k") <= most).drop("__k")
    daily = newest(frames.withColumn("__day", F.to_date("time")), [*by, "__day"])  # no camera is one task
    days = daily.groupBy(*by, "__day").agg(F.count("*").alias("__n"))
    later = F.sum("__n").over(Window.partitionBy(*by).orderBy(F.desc("__day"))) - F.col("__n")  # one row a day
    days = days.withColumn("__later", later).where(F.col("__later") < most).select(*by, "__day")
    return newest(daily.join(days, [*by, "__day"], "left_semi").drop("__day"), by)


def pair_stations(bottom: DataFrame, top: DataFrame, tolerance_s: int = 1800) -> DataFrame:
    """(time, t_bottom, t_top) of two stations' readings, the nearest within the tolerance."""
    b = bottom.where("value is not null").select("time", F.col("value").alias("t_bottom"))
    t = top.where("value is not null").select(F.col("time").alias("time_top"), F.col("value").alias("t_top"))
    return nearest_asof(b, t, left_on="time", right_on="time_top", tolerance_s=tolerance_s).select("time", "t_bottom", "t_top")


def freezing_levels(paired: DataFrame) -> DataFrame:
    h0, lower, upper, regime = scalar.freezing_level(F.col("t_bottom"), F.col("t_top"))
    df = paired.withColumns({"h0": h0, "lower": lower, "upper": upper, "regime": regime})
    return df.withColumn("shown", scalar.shows_band(F.col("h0"), F.col("lower"), F.col("upper"), F.col("regime")))


def missing_models(expected: DataFrame, got: DataFrame, keys: Sequence[str] = ("location",)) -> DataFrame:
    """(keys, missing): the models of `expected` that `got` lacks, in order."""
    gone = expected.select(*keys, "model").distinct().join(got.select(*keys, "model").distinct(), [*keys, "model"], "left_anti")
    return gone.groupBy(*keys).agg(F.array_sort(F.collect_list("model")).alias("missing"))


def first_and_last(df: DataFrame, by: Sequence[str], order: str = "pos", value: str = "v") -> DataFrame:
    """(by, first, first_v, last, last_v, n): the ends of each sequence that have a value."""
    at = F.when(F.col(value).isNotNull(), F.col(order))
    return df.groupBy(*by).agg(F.min(at).alias("first"), F.min_by(value, at).alias("first_v"), F.max(at).alias("last"), F.max_by(value, at).alias("last_v"), F.count(value).alias("n"))


def next_days(daily: DataFrame, after: Column, most: int = 7, by: Sequence[str] = ("location",)) -> DataFrame:
    """The first `most` days of each group after a day, however far ahead. Each task gives away no more than so many of a group."""
    ahead = daily.where(F.col("day") > after)
    w = Window.partitionBy(*by).orderBy("day")
    return ahead.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")


def keys_of_any(base: DataFrame, others: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """base's rows whose keys are in one of the others at least."""
    known = reduce(DataFrame.unionByName, [o.select(*keys) for o in others]).distinct()
    return base.join(known, list(keys), "left_semi")


def recent_observations(readings: DataFrame, now: Column, days: int = 7, moved: Sequence[str] = ("snow_depth",)) -> DataFrame:
    """(location, variable, time, value) of the last days of readings(location, site_id, variable, time, value).

    Variables in `moved` can't be compared across a station's sites: of those only the site of the newest reading
    stays, for each location.
    """
    df = readings.where(F.unix_micros("time") >= F.unix_micros(now) - days * 86_400_000_000)
    site = F.max_by("site_id", F.struct("time", "site_id"))
    current = df.where(F.col("variable").isin(*moved)).groupBy("location", "variable").agg(site.alias("__site"))  # one row a series
    df = df.join(current, ["location", "variable"], "left").where(F.col("__site").isNull() | F.col("site_id").eqNullSafe(F.col("__site")))
    return df.select("location", "variable", "time", "value")


def frame_manifest(frames: DataFrame, now: Column, recent_days: int = 30, by: str = "camera") -> DataFrame:
    """(camera, time, key, is_latest) of the frames that are kept for display."""
    kept = thin_frames(frames, now, recent_days, by=(by,))
    newest = kept.groupBy(by).agg(F.max("time").alias("__last"))
    return kept.join(newest, by).select(by, "time", scalar.frame_key(F.col(by), F.col("time")).alias("key"), (F.col("time") == F.col("__last")).alias("is_latest"))


def unseen(new: DataFrame, logged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return new.join(logged.select(*keys), list(keys), "left_anti")


def same_content(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have equal rows; one action that ends with the first difference."""
    return a.columns == b.columns and a.exceptAll(b).unionByName(b.exceptAll(a)).limit(1).count() == 0
