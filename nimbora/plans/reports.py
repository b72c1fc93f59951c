"""Whole reports as DataFrames: each joins what the operators give, and none collects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.functions import scalar
from nimbora.functions import time as ft
from nimbora.operators import blend, ensemble, history, resampling, series, verification
from nimbora.session import stored
from nimbora.sources.logs import latest_run


def verification_report(forecasts: DataFrame, observations: DataFrame, by: Sequence[str] = ("location",), temperature: bool = True, strata_n: int = verification.MIN_N, band_n: int = 50, **walk) -> dict[str, DataFrame]:
    """Everything that is known of the models' skill, for all locations in one plan: by lead, overall, by condition, winners, the blend and its band."""
    pairs = verification.align(forecasts, observations, by)
    blended = blend.walk_forward(pairs, by, **walk)
    every = pairs.unionByName(blended, allowMissingColumns=True)
    return {
        "by_lead": verification.metrics_by_lead(every, by), "overall": verification.overall_metrics(every, by), "winners": verification.winners_by_lead(pairs, by),
        "strata": verification.stratified_metrics(verification.with_strata(pairs, temperature), by=by, min_n=strata_n), "band": blend.residual_quantiles(blended, by, min_n=band_n),
        "coverage": blend.band_coverage(blended, by, min_n=band_n), "against_blend": blend_against_best(pairs, blended, by),
        "period": pairs.groupBy(*by).agg(F.min("valid_time").alias("first"), F.max("valid_time").alias("last"), F.count("*").alias("n_pairs")),
    }


def blend_against_best(pairs: DataFrame, blended: DataFrame, by: Sequence[str] = ("location",)) -> DataFrame:
    """(by, lead_day, model, comparison): the blend against the best raw model of each lead on the forecasts they share."""
    keys = [*by, "lead_day"]
    mae = pairs.groupBy(*keys, "model").agg(F.avg("abs_error").alias("mae"), F.count("*").alias("n")).where(F.col("n") >= verification.MIN_N)
    best = mae.groupBy(*keys).agg(F.min(F.struct("mae", "model")).alias("b")).select(*keys, F.col("b.model").alias("model"))
    columns = [*keys, "model", "issued_at", "valid_time", "abs_error"]
    raw = pairs.join(best, [*keys, "model"], "left_semi").select(*columns)
    return verification.compare_models(raw.unionByName(blended.select(*columns)), keys)


def live_blend_with_band(live: DataFrame, pairs: DataFrame, band: DataFrame, asof: Column, by: Sequence[str] = ("location",), **learn) -> DataFrame:
    """The newest run blended, with the band of its leads."""
    rows = latest_run(live, by).withColumn("lead_day", ft.lead_day(F.col("valid_time"), F.col(verification.run_start(live))))
    return blend.with_band(blend.live_blend(rows, blend.learn_coefficients(pairs, asof, by, **learn), by), band, by)


def past_day_ahead_blend(forecasts: DataFrame, pairs: DataFrame, band: DataFrame, start: Column, end: Column, by: Sequence[str] = ("location",), **learn) -> DataFrame:
    """What the blend said a day ahead, for the past hours."""
    coef = blend.learn_coefficients(pairs, start, by, **learn)
    return blend.with_band(blend.live_blend(verification.day_ahead(forecasts, start, end, by), coef, by), band, by)


def ensemble_report(members: DataFrame, observations: DataFrame, deterministic: DataFrame, by: Sequence[str] = ("location",), sibling: str | None = None) -> DataFrame:
    inst = ensemble.instance_scores(ensemble.collect_members(members, by), observations, by)
    scores = ensemble.scores_by_lead(inst, by)
    return scores.join(ensemble.rivals_by_lead(inst, deterministic, by, sibling, blend.BLEND), [*by, "ensemble", "lead_day"], "left")


def freezing_level_report(bottom: DataFrame, top: DataFrame) -> DataFrame:
    """Estimates that may be shown, smoothed within runs without a gap."""
    shown = series.freezing_levels(series.pair_stations(bottom, top)).where("shown").withColumn("location", F.lit("mountain"))
    return series.smooth_in_islands(shown.withColumnRenamed("time", "ts"), ["location"], "h0").select("ts", "smooth", "lower", "upper", "regime")


def forecast_grid(forecasts: DataFrame, start: Column, end: Column, by: Sequence[str] = ("location",)) -> DataFrame:
    """(by, model, times, values) of the newest run within a span, all models on one time axis."""
    rows = latest_run(forecasts, by).where(F.col("valid_time").between(start, end))
    return series.as_arrays(series.align_on_times(rows, ("model",), by), ("model",), by)


def season_chart(daily: DataFrame, kind: str, years: tuple[int, int], by: Sequence[str] = ("location",), min_seasons: int = 10) -> dict[str, DataFrame]:
    """Running means by season and position, the normal band by day of the year, and the average line."""
    smooth = history.running_mean(daily, by)
    long = history.season_long(smooth, kind, by)
    return {"lines": long, "band": history.doy_climatology(smooth, years, by=by), "average": history.average_line(long, by, min_seasons)}


def snow_chart(daily: DataFrame, end_year: int, by: Sequence[str] = ("location",), min_coverage: float = 0.3, min_seasons: int = 8, least: float = 20.0, from_pos: int = 61) -> dict[str, DataFrame]:
    """A snow season against others: `current` and `past` by season and position, a `band` of the past ones, and a `summary`.

    Past seasons have values on min_coverage of their days. The band needs min_seasons at a date. The summary compares the newest depth with each past season's mean within a
    day of it: its rank among at least four, and its percentage of their median from from_pos on where that is at least `least`.
    """
    long = history.season_long(daily, "snow", by)
    seasons = [*by, "season_year"]
    enough = long.groupBy(*seasons).agg(F.count("v").alias("n")).where(F.col("n") >= min_coverage * ft.SEASON_DAYS["snow"])
    past = long.where(F.col("season_year") != end_year).join(enough, seasons, "left_semi")
    current = long.where(F.col("season_year") == end_year)
    now = current.groupBy(*by).agg(F.max("pos").alias("pos"), F.max_by("v", "pos").alias("depth"))
    near = past.join(now.select(*by, F.col("pos").alias("__p")), list(by)).where(F.abs(F.col("pos") - F.col("__p")) <= 1).groupBy(*seasons).agg(F.avg("v").alias("at"))
    g = near.join(now.select(*by, "depth"), list(by)).groupBy(*by).agg(F.count("at").alias("n"), F.count_if(F.col("at") > F.col("depth")).alias("beaten"), F.median("at").alias("median"))  # a row a season
    few = F.col("n") >= 4
    percent = F.when(few & (F.col("pos") >= from_pos) & (F.col("median") >= least), 100 * F.col("depth") / F.col("median"))
    summary = now.join(g, list(by), "left").select(*by, "pos", "depth", F.when(few, F.col("beaten") + 1).alias("rank"), F.when(few, F.col("n") + 1).alias("n_seasons"), percent.alias("pct_of_median"))
    return {"band": history.season_band(past, "snow", by, min_seasons=min_seasons, quantiles=history.QUANTILES), "current": current, "past": past, "summary": summary}


def modelled_snowpack(daily: DataFrame, end_year: int, years: tuple[int, int], by: Sequence[str] = ("location",), window: int = 7) -> dict[str, DataFrame]:
    """A model's snow depth as a percentage of its own median for the date, from December on: the `band` by day of the year, `lines` of this season and the one before, and the newest value's `summary`.

    The days are written first: the newest value is looked up in its own pool, and means that two branches compute may differ in their last bit.
    """
    daily = stored(daily, "days")
    median = history.doy_climatology(daily, years, window, (0.5,), by).select(*by, "doy", F.col("q")[0].alias("median"))
    ratio = history.percent_of_median(daily, median, by).where("pct_of_median is not null").select(*by, "day", F.col("pct_of_median").alias("v"))
    lines = history.season_long(ratio, "snow", by).where(F.col("season_year").isin(end_year, end_year - 1))
    season = ratio.where(ft.season_year(F.col("day"), "snow") == end_year)
    newest = season.groupBy(*by).agg(F.max("day").alias("day"), F.max_by("v", "day").alias("v"))
    summary = history.day_percentiles(ratio, newest, years, window, by).select(*by, "day", F.col("v").alias("pct_of_median"), F.col("pct").alias("percentile"))
    return {"band": history.doy_climatology(ratio, years, window, by=by), "lines": lines, "summary": summary}


def season_extension(daily: DataFrame, forecast: DataFrame, by: Sequence[str] = ("location",), window: int = 7) -> DataFrame:
    """The running mean carried on over forecast days, from the day after the last observed one."""
    last = daily.groupBy(*by).agg(F.max("day").alias("__last"))
    ahead = forecast.join(last, list(by)).where("day > __last").drop("__last")
    smooth = history.running_mean(daily.select(*by, "day", "v").unionByName(ahead.select(*by, "day", "v")), by, window)
    return smooth.join(last, list(by)).where("day > __last").drop("__last")


def season_summary(daily: DataFrame, kind: str, end_year: int, years: tuple[int, int], by: Sequence[str] = ("location",)) -> DataFrame:
    """(by, v, pct, rank, out_of): a season so far against the same days of others."""
    long = history.season_long(daily, kind, by)
    means = history.same_days_means(long, long.where(F.col("season_year") == end_year), by)
    ranked = history.rank_among(means, by)
    now = ranked.where(F.col("season_year") == end_year).select(*by, "v", "rank", "out_of")
    others = means.where((F.col("season_year") != end_year) & F.col("season_year").between(*[F.lit(y) for y in years])).select(*by, F.col("v").alias("ref"))
    return history.percentile_rank(now, others, by)


def unusual_days(daily: DataFrame, recent: DataFrame, years: tuple[int, int], by: Sequence[str] = ("location",)) -> DataFrame:
    """recent(by, day, v) with its percentile among the days around the same date, and words for it."""
    rows = recent.select(*by, "day", "v")
    return history.day_percentiles(daily, rows, years, by=by).withColumns({"doy": ft.day_of_year(F.col("day")), "label": scalar.percentile_class(F.col("pct"))})


def long_view(sources: dict[str, DataFrame], kinds: Sequence[str] = ("winter", "summer", "year"), since: int | None = None, n_boot: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(trends, statements) of daily series by source and kind of season."""
    parts = None
    for name, daily in sources.items():
        for kind in kinds:
            one = history.season_means(daily.withColumn("source", F.lit(name)), kind, ["source"]).withColumn("kind", F.lit(kind))
            parts = one if parts is None else parts.unionByName(one)
    if since is not None:
        parts = parts.where(F.col("year") >= since)
    trends = resampling.sen_slope_range(parts, ["kind", "source"], n_boot=n_boot)
    return trends, resampling.trend_statement(trends, ["kind"])


def masked(df: DataFrame, measured: Sequence[str], allowed: bool | None) -> DataFrame:
    """df with its measured columns as nulls unless publication is allowed; an unstated permission is refused."""
    if allowed is None:
        raise ValueError("say whether measured values may be shown")
    return df if allowed else df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in measured})


def blend_against_best_pooled(pairs: DataFrame, blended: DataFrame, by: Sequence[str] = ("location",), min_n: int = verification.MIN_N) -> DataFrame:
    """(by, day, a, b, n): daily sums of the blend's errors (a) and those of the best raw model of each lead (b), over all leads with enough shared forecasts.

    A forecast meets the best model of every lead that has its issue and valid time, as the pooled headline does.
    """
    keys, shared = [*by, "lead_day"], [*by, "issued_at", "valid_time"]
    mae = pairs.groupBy(*keys, "model").agg(F.avg("abs_error").alias("mae"), F.count("*").alias("n")).where(F.col("n") >= min_n)
    best = mae.groupBy(*keys).agg(F.min_by("model", F.struct("mae", "model")).alias("model"))
    raw = pairs.join(best, [*keys, "model"], "left_semi").select(*keys, "issued_at", "valid_time", F.col("abs_error").alias("b"))
    own = blended.select(*keys, "issued_at", "valid_time", F.col("abs_error").alias("a"))
    leads = own.join(raw, [*keys, "issued_at", "valid_time"]).groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= min_n)
    both = own.join(leads, keys, "left_semi").drop("lead_day").join(raw.join(leads, keys, "left_semi").drop("lead_day"), shared)
    return both.groupBy(*by, F.to_date("valid_time").alias("day")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n"))


def past_forecast_grid(forecasts: DataFrame, start: Column, end: Column, by: Sequence[str] = ("location",), lead_hours: int = 24) -> DataFrame:
    """(by, model, times, values): what each model said a day ahead for the past hours, all models on one time axis; of repeated rows the last."""
    return series.as_arrays(series.align_on_times(verification.day_ahead(forecasts, start, end, by, lead_hours).where("value is not null"), ("model",), by), ("model",), by)


def blend_daily_means(rows: DataFrame, by: Sequence[str] = ("location",), columns: Sequence[str] = ("value", "lower", "upper"), min_hours: int = 20, tz: str = ft.LOCAL_TZ) -> DataFrame:
    """(by, day, columns): means of the local days on which every column has enough hours."""
    enough = [F.count(c) >= min_hours for c in columns]
    g = rows.groupBy(*by, ft.local_day(F.col("valid_time"), tz).alias("day")).agg(*[F.avg(c).alias(c) for c in columns], *[e.alias(f"__{c}") for c, e in zip(columns, enough, strict=True)])
    return g.where(" and ".join(f"__{c}" for c in columns)).select(*by, "day", *columns)


def station_adjustment(station: DataFrame, model: DataFrame, by: Sequence[str] = ("location",), since: str | None = None, n_boot: int = 2000) -> dict[str, DataFrame]:
    """How a reanalysis is fitted to a station: offsets by month, days of overlap, coverage of the adjusted band, and the step at `since`."""
    fit = station.where(F.col("day") >= F.lit(since).cast("date")) if since else station
    overlap = history.difference(model, fit, by).groupBy(*by).agg(F.count("*").alias("n_overlap"), (F.count("*") < 3 * 365).alias("provisional"))
    out = {"offsets": history.monthly_offsets(model, fit, by), "overlap": overlap, "coverage_daily": history.adjusted_band_coverage(model, fit, by), "coverage_7day": history.adjusted_band_coverage(model, fit, by, smooth=7)}
    return out | ({"step": resampling.step_change(station, model, since, by, n_boot)} if since else {})


def enso_card(winter_means: DataFrame, winters: DataFrame, by: Sequence[str] = ("location",), n_perm: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(classes, tests): detrended winters by phase, and whether the strongest warm phase differs from all others by more than chance, with words."""
    anomalies = history.detrend(winter_means, by)
    phases = winters.select("year", scalar.enso_class(F.col("anom")).alias("phase"))
    marked = anomalies.join(phases, "year").withColumn("in_a", F.col("phase") == scalar.ENSO_CLASSES[-1])
    tests = resampling.permutation_test(marked, by, n_perm).withColumn("p", F.round("p", 3))
    return history.enso_composite(anomalies, winters, by), tests.withColumn("words", scalar.chance_text(F.col("p")))


def model_availability(expected: DataFrame, forecasts: DataFrame, keys: Sequence[str] = ("location",)) -> DataFrame:
    """(keys, model, rows, available): each expected model with how many rows it gave."""
    got = forecasts.where("value is not null").groupBy(*keys, "model").agg(F.count("*").alias("rows"))
    return expected.select(*keys, "model").distinct().join(got, [*keys, "model"], "left").select(*keys, "model", F.coalesce("rows", F.lit(0)).alias("rows"), F.col("rows").isNotNull().alias("available"))
