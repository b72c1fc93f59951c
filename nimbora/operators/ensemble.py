"""Scores of ensembles: fair CRPS, spread, coverage, causal bias correction, deterministic rivals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.functions import scalar
from nimbora.functions import time as ft
from nimbora.operators.asof import backward_asof, nearest_asof, trailing_mean
from nimbora.operators.verification import run_start

MIN_MEMBERS, MIN_DAYS, BIAS_DAYS, BIAS_MIN_N, LEVEL, SAME_JOB_S, COMPLETE = 15, 5, 30, 48, 0.8, 1800, 0.95


def collect_members(forecasts: DataFrame, by: Sequence[str] = ("location",)) -> DataFrame:
    """(by, ensemble, issued_at, valid_time, start, members): one row for each forecast of an ensemble."""
    df = forecasts.where("valid_time >= issued_at and value is not null").withColumn("ensemble", scalar.base_model(F.col("model")))
    start = F.col(run_start(df)).alias("start")
    return df.groupBy(*by, "ensemble", "issued_at", "valid_time", start).agg(F.collect_list("value").alias("members"))


def member_scores(df: DataFrame, level: float = LEVEL, min_members: int = MIN_MEMBERS) -> DataFrame:
    """df(members, observed, ...) plus mean, spread, crps, the band's bounds, inside and n_members."""
    low, high = (scalar.array_quantile(F.col("members"), q) for q in ((1 - level) / 2, 1 - (1 - level) / 2))
    n = F.size("members")
    mean = F.aggregate("members", F.lit(0.0), lambda s, v: s + v) / n
    df = df.where(n >= min_members).withColumns({"n_members": n, "mean": mean, "lo": low, "hi": high})
    squares = F.aggregate("members", F.lit(0.0), lambda s, v: s + (v - F.col("mean")) * (v - F.col("mean")))
    return df.withColumns({
        "spread": F.sqrt(squares / (n - 1)), "crps": scalar.fair_crps(F.col("members"), F.col("observed")),
        "inside": F.col("observed").between(F.col("lo"), F.col("hi")),
    })


def instance_scores(members: DataFrame, observations: DataFrame, by: Sequence[str] = ("location",), tolerance_s: int = 1800, window_days: int = BIAS_DAYS, min_n: int = BIAS_MIN_N) -> DataFrame:
    """Every forecast of an ensemble against the nearest observation, raw and with the bias removed that was known when it was issued."""
    obs = observations.where("value is not null").select(*by, "time", F.col("value").alias("observed"))
    df = nearest_asof(members, obs, left_on="valid_time", right_on="time", by=list(by), tolerance_s=tolerance_s).drop("time")
    df = member_scores(df).withColumn("lead_day", ft.lead_day(F.col("valid_time"), F.col("start")))
    df = df.withColumn("__error", F.col("mean") - F.col("observed"))
    df = trailing_mean(df, value="__error", happened="valid_time", asked="issued_at", by=[*by, "ensemble", "lead_day"], window_days=window_days, min_n=min_n, out="bias")
    shifted = F.col("observed") + F.col("bias")  # moving all members down is moving the observation up
    return df.withColumns({
        "crps_bc": F.when(F.col("bias").isNotNull(), scalar.fair_crps(F.col("members"), shifted)), "inside_bc": shifted.between(F.col("lo"), F.col("hi")),
    }).drop("__error")


def same_job(instances: DataFrame, deterministic: DataFrame, by: Sequence[str] = ("location",), tolerance_s: int = SAME_JOB_S) -> DataFrame:
    """instances plus det_issued: the deterministic fetch of the same job, the newest up to the tolerance earlier."""
    fetched = deterministic.select(*by, F.col("issued_at").alias("det_issued")).distinct()
    return backward_asof(instances, fetched, left_on="issued_at", right_on="det_issued", by=list(by), tolerance_s=tolerance_s)


def scores_by_lead(instances: DataFrame, by: Sequence[str] = ("location",), min_n: int = 20, min_days: int = MIN_DAYS) -> DataFrame:
    """Scores of each ensemble and lead day; the corrected ones where enough days have a known bias."""
    e, c = F.col("mean") - F.col("observed"), F.col("mean") - F.col("bias") - F.col("observed")
    known = F.col("bias").isNotNull()
    day = F.to_date("issued_at")
    rms = lambda x: F.sqrt(F.avg(x * x))
    g = instances.groupBy(*by, "ensemble", "lead_day").agg(
        F.count("*").alias("n"), F.count_distinct(day).alias("days"), F.avg("crps").alias("crps"), F.avg(F.abs(e)).alias("mean_mae"), F.avg(e).alias("bias"),
        rms(F.col("spread")).alias("spread"), rms(e).alias("rmse"), F.avg(F.col("inside").cast("double")).alias("coverage"),
        F.count_if(known).alias("known"), F.count_distinct(F.when(known, day)).alias("known_days"), F.avg("crps_bc").alias("crps_bc"), F.avg(F.abs(c)).alias("mean_mae_bc"),
        rms(F.when(known, F.col("spread"))).alias("spread_c"), rms(c).alias("rmse_c"), F.avg(F.col("inside_bc").cast("double")).alias("coverage_bc"),
    )
    g = g.where((F.col("n") >= min_n) & (F.col("days") >= min_days)).withColumn("n_bc", F.when(F.col("known_days") >= min_days, F.col("known")).otherwise(0))
    enough = lambda x: F.when(F.col("n_bc") >= min_n, x)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return g.select(
        *by, "ensemble", "lead_day", "n", "days", "crps", "mean_mae", "bias", "spread", ratio("spread", "rmse").alias("spread_skill"), "coverage", "n_bc",
        *[enough(F.col(x)).alias(x) for x in ("crps_bc", "mean_mae_bc", "coverage_bc")], enough(ratio("spread_c", "rmse_c")).alias("spread_skill_bc"),
    )


def rivals_by_lead(instances: DataFrame, deterministic: DataFrame, by: Sequence[str] = ("location",), sibling: str | None = None, blend: str | None = None, min_n: int = 20, complete: float = COMPLETE) -> DataFrame:
    """On the ensemble's own hours and jobs the MAE of the best raw model, a sibling model and the blend.

    Only models with a forecast for at least the share `complete` of the hours compete.
    """
    inst = same_job(instances, deterministic, by)
    det = deterministic.select(*by, F.col("issued_at").alias("det_issued"), "valid_time", "model", "abs_error")
    keys = [*by, "ensemble", "lead_day"]
    size = inst.groupBy(*keys).agg(F.count("*").alias("n"), F.count("bias").alias("n_bc"))
    joined = inst.select(*keys, "det_issued", "valid_time", "bias").join(det, [*by, "det_issued", "valid_time"])
    mae = joined.groupBy(*keys, "model").agg(F.avg("abs_error").alias("mae"), F.count("*").alias("m"), F.avg(F.when(F.col("bias").isNotNull(), F.col("abs_error"))).alias("mae_bc"), F.count("bias").alias("m_bc"))
    mae = mae.join(size, keys).where(F.col("m") >= complete * F.col("n"))
    is_blend = F.col("model") == F.lit(blend)
    raw = mae.where(~F.coalesce(is_blend, F.lit(False))) if blend else mae
    best = raw.groupBy(*keys).agg(F.min(F.struct("mae", "model")).alias("b")).select(*keys, F.col("b.model").alias("best_model"), F.col("b.mae").alias("best_mae"))
    both = (F.col("m_bc") >= complete * F.col("n_bc")) & (F.col("n_bc") >= min_n)
    other = mae.groupBy(*keys).agg(
        F.max(F.when(F.col("model") == F.lit(sibling), F.col("mae"))).alias("sibling_mae"), F.max(F.when(is_blend, F.col("mae"))).alias("blend_mae"), F.max(F.when(is_blend & both, F.col("mae_bc"))).alias("blend_mae_bc")
    )
    return size.select(*keys).join(best, keys, "left").join(other, keys, "left")


def mae_on_subset(deterministic: DataFrame, subset: DataFrame, keys: Sequence[str], complete: float = COMPLETE) -> DataFrame:
    """Each model's MAE on a set of keys, for models that have at least the given share of it."""
    hit = deterministic.join(subset.select(*keys).distinct(), list(keys), "left_semi")
    total = subset.select(*keys).distinct().agg(F.count("*").alias("total"))
    out = hit.groupBy("model").agg(F.avg("abs_error").alias("mae"), F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row
    return out.where(F.col("n") >= complete * F.col("total")).select("model", "mae", "n")
