"""Blends of models: bias-corrected, weighted by skill, trained strictly on what came before."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbora.functions import scalar
from nimbora.functions import time as ft
from nimbora.operators import ranks

BLEND = "blend"
WINDOW_DAYS, MIN_TRAIN, MIN_MEMBERS, MAE_FLOOR, POWER, LEVEL = 90, 30, 2, 0.5, 2.0, 0.8
KEYS = ("model", "lead_day", "part_of_day")

Weight = Callable[[Column], Column]


def inverse_power(power: float = POWER, floor: float = MAE_FLOOR) -> Weight:
    return lambda mae: F.lit(1.0) / F.pow(F.greatest(mae, F.lit(floor)), F.lit(power))


def softmax(scale: float = 0.7, floor: float = MAE_FLOOR) -> Weight:
    return lambda mae: F.exp(-F.greatest(mae, F.lit(floor)) / F.lit(scale))


#: The weightings of the sweep: how a member's past error becomes its weight.
WEIGHTINGS: dict[str, Weight] = {
    "equal": lambda mae: F.lit(1.0), "1/mae": inverse_power(1.0), "1/mae^2": inverse_power(2.0), "1/mae^3": inverse_power(3.0), "softmax": softmax(),
}


def with_part_of_day(df: DataFrame) -> DataFrame:
    return df if "part_of_day" in df.columns else df.withColumn("part_of_day", ft.part_of_day(F.col("valid_time")))


def _coefficients(train: DataFrame, keys: list[str], min_train: int) -> DataFrame:
    coef = train.groupBy(*keys).agg(F.avg("error").alias("bias"), F.avg("abs_error").alias("mae"), F.count("error").alias("n"))
    return coef.where(F.col("n") >= min_train)


def learn_coefficients(pairs: DataFrame, asof: Column, by: Sequence[str] = ("location",), window_days: int = WINDOW_DAYS, min_train: int = MIN_TRAIN, weight: Weight | None = None) -> DataFrame:
    """Bias and weight of each model, lead and part of the day from the window of days before `asof`."""
    t = F.unix_micros("valid_time")
    train = pairs.where((t < F.unix_micros(asof)) & (t >= F.unix_micros(asof) - window_days * 86_400_000_000))
    return _coefficients(with_part_of_day(train), [*by, *KEYS], min_train).withColumn("weight", (weight or inverse_power())(F.col("mae")))


def _combined(df: DataFrame, keys: list[str], min_members: int) -> DataFrame:
    w = F.col("weight")
    carried = [F.min("observed").alias("observed")] if "observed" in df.columns else []
    out = df.groupBy(*keys).agg((F.sum(w * (F.col("value") - F.col("bias"))) / F.sum(w)).alias("value"), F.count("*").alias("n_members"), *carried)
    return out.where(F.col("n_members") >= min_members)


def block_start(ts: Column, block: str) -> Column:
    return F.date_trunc(block, ts)


def trained_members(pairs: DataFrame, by: Sequence[str] = ("location",), window_days: int = WINDOW_DAYS, min_train: int = MIN_TRAIN, block: str = "month", regime: Sequence[str] = ("part_of_day",)) -> DataFrame:
    """pairs plus the bias and mae that each one's model had shown before the block of time began in which it was issued, and its rank by mae among those that
    forecast the same hour.

    There is no loop over blocks, and no pair is copied: errors are summed up by model, lead, regime and day, and each block's
    coefficients are one frame of days over these sums, so shorter blocks cost no more than longer ones.
    """
    df = with_part_of_day(pairs)
    keys = [*by, "model", "lead_day", *regime]
    days = df.groupBy(*keys, F.unix_date(F.to_date("valid_time")).alias("__d")).agg(F.sum("error").alias("__e"), F.sum("abs_error").alias("__a"), F.count("error").alias("__n"))
    asked = df.select(*keys, block_start(F.col("issued_at"), block).alias("block")).distinct().withColumn("__d", F.unix_date(F.to_date("block")))
    w = Window.partitionBy(*keys).orderBy("__d").rangeBetween(-window_days, -1)  # a row a day
    sums = {c: F.sum(c).over(w) for c in ("__e", "__a", "__n")}
    coef = days.unionByName(asked, allowMissingColumns=True).withColumns({f"{c}w": s for c, s in sums.items()}).where(F.col("block").isNotNull() & (F.col("__nw") >= min_train))
    coef = coef.select("block", *keys, (F.col("__ew") / F.col("__nw")).alias("bias"), (F.col("__aw") / F.col("__nw")).alias("mae"))
    members = df.withColumn("block", block_start(F.col("issued_at"), block)).join(coef, ["block", *keys])
    forecast = Window.partitionBy(*by, "issued_at", "valid_time", "lead_day").orderBy("mae", "model")  # one row a model
    return members.withColumn("rank", F.row_number().over(forecast))


def walk_forward(pairs: DataFrame, by: Sequence[str] = ("location",), min_members: int = MIN_MEMBERS, weight: Weight | None = None, top_n: int | None = None, **learn) -> DataFrame:
    """Out-of-sample blend pairs: what is issued in a block of time is blended with what was learned before the block began (see trained_members)."""
    test = trained_members(pairs, by, **learn)
    if top_n:
        test = test.where(F.col("rank") <= top_n)
    test = test.withColumn("weight", (weight or inverse_power())(F.col("mae")))
    out = _combined(test, [*by, "issued_at", "valid_time", "lead_day"], min_members)
    out = out.withColumns({"model": F.lit(BLEND), "source": F.lit("blend"), "error": F.col("value") - F.col("observed")})
    return out.withColumn("abs_error", F.abs("error"))


def live_blend(rows: DataFrame, coef: DataFrame, by: Sequence[str] = ("location",), min_members: int = MIN_MEMBERS) -> DataFrame:
    """(by, valid_time, lead_day, value, n_members) of the latest forecasts with learned coefficients."""
    joined = with_part_of_day(rows).drop("observed").join(coef.select(*by, *KEYS, "bias", "weight"), [*by, *KEYS])
    return _combined(joined, [*by, "valid_time", "lead_day"], min_members)


def residual_quantiles(pairs: DataFrame, by: Sequence[str] = ("location",), level: float = LEVEL, min_n: int = 50) -> DataFrame:
    """(by, lead_day, low, high, n): exact quantiles of the signed error that hold the central share `level`."""
    out = ranks.quantiles(pairs, [*by, "lead_day"], "error", [(1 - level) / 2, 1 - (1 - level) / 2]).where(F.col("n") >= min_n)
    return out.select(*by, "lead_day", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "n")


def band_coverage(pairs: DataFrame, by: Sequence[str] = ("location",), level: float = LEVEL, split: float = 0.7, min_n: int = 50) -> DataFrame:
    """(by, coverage, n): how much of the later issue times a band learned on the earlier ones holds."""
    micros = pairs.withColumn("__t", F.unix_micros("issued_at").cast("double"))  # exact below 2^53
    cut = ranks.quantiles(micros, by, "__t", [split]).select(*by, F.col("q")[0].alias("cut"))
    df = pairs.join(cut, list(by))
    late = F.unix_micros("issued_at") > F.col("cut")
    band = residual_quantiles(df.where(~late), by, level, min_n).drop("n")
    test = df.where(late).join(band, [*by, "lead_day"])
    return test.groupBy(*by).agg(F.avg(F.col("error").between(F.col("low"), F.col("high")).cast("double")).alias("coverage"), F.count("*").alias("n"))


def weighting_sweep(pairs: DataFrame, by: Sequence[str] = ("location",), min_members: int = MIN_MEMBERS, **walk) -> DataFrame:
    """(by, scheme, n, mae) of every weighting, and of the best three and the best one model.

    What the members have learned doesn't depend on the weighting: one pass learns it, and one aggregation combines
    the members under all schemes.
    """
    members = trained_members(pairs, by, **walk)
    keys = [*by, "issued_at", "valid_time", "lead_day"]
    schemes = {name: (w(F.col("mae")), min_members) for name, w in WEIGHTINGS.items()}
    schemes |= {"top-3": (F.when(F.col("rank") <= 3, inverse_power(1.0)(F.col("mae"))), min_members), "best-1": (F.when(F.col("rank") == 1, F.lit(1.0)), 1)}
    weights = F.explode(F.array(*[F.struct(F.lit(name).alias("scheme"), w.alias("weight"), F.lit(least).alias("least")) for name, (w, least) in schemes.items()])).alias("s")
    rows = members.select(*keys, "value", "observed", "bias", weights).select("*", "s.*").where("weight is not null")
    blended = _combined(rows, [*keys, "scheme", "least"], 1).where(F.col("n_members") >= F.col("least"))
    return blended.groupBy(*by, "scheme").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("value") - F.col("observed"))).alias("mae")).select(*by, "n", "mae", "scheme")


#: What a model's past errors are parted by in the sweep over regimes.
REGIMES: dict[str, Sequence[str]] = {"none": (), "season": ("season",), "part_of_day": ("part_of_day",), "forecast": ("forecast_bin",)}


def regime_sweep(pairs: DataFrame, by: Sequence[str] = ("location",), regimes: dict[str, Sequence[str]] = REGIMES, **walk) -> DataFrame:
    """(by, regime, scheme, n, mae) of every weighting under every way to part the past errors."""
    df = with_part_of_day(pairs).withColumns({"season": ft.season_of_year(F.col("valid_time")), "forecast_bin": scalar.temperature_bin(F.col("value"))})
    parts = [weighting_sweep(df, by, regime=columns, **walk).withColumn("regime", F.lit(name)) for name, columns in regimes.items()]
    return reduce(DataFrame.unionByName, parts).select(*by, "regime", "scheme", "n", "mae")


def with_band(rows: DataFrame, band: DataFrame, by: Sequence[str] = ("location",)) -> DataFrame:
    """Blended values with the bounds of their lead's band; null where none was learned."""
    df = rows.join(band.select(*by, "lead_day", F.col("low").alias("__l"), F.col("high").alias("__h")), [*by, "lead_day"], "left")
    return df.withColumns({"lower": F.col("value") + F.col("__l"), "upper": F.col("value") + F.col("__h")}).drop("__l", "__h")
