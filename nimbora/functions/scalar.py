"""Labels, classes, weather formulas and array statistics as Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Right-closed bins of an observed temperature, with their labels.
TEMPERATURE_BINS = ((-10.0, "≤ −10"), (0.0, "−10 to 0"), (10.0, "0 to 10"), (math.inf, "> 10"))
ENSO_CLASSES = ("moderate/strong La Niña", "weak La Niña", "neutral", "weak El Niño", "moderate/strong El Niño")
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
BOTTOM_M, TOP_M, SIGMA_C = 740.0, 1150.0, 1.0  # station heights; uncertainty of one temperature


def temperature_bin(value: Column) -> Column:
    """The bin's label; a missing value is the label "nan", which is a group of its own."""
    out = F.when(value.isNull() | F.isnan(value), "nan")
    for high, label in TEMPERATURE_BINS:
        out = out.when(value <= F.lit(high), label)
    return out


def enso_class(value: Column) -> Column:
    limits = (value <= -1.0, value <= -0.5, value < 0.5, value < 1.0, value.isNotNull())
    out = F.when(F.isnan(value), F.lit(None))
    for test, label in zip(limits, ENSO_CLASSES, strict=True):
        out = out.when(test, label)
    return out


def percentile_class(value: Column) -> Column:
    """Words for a percentile: below 10, 25, 75, 90, and from there on."""
    return F.when(value < 10, "much below").when(value < 25, "below").when(value < 75, "near normal").when(value < 90, "above").when(value.isNotNull(), "much above")


def clean(value: Column) -> Column:
    """NaN as null."""
    return F.nanvl(value, F.lit(None).cast("double"))


def base_model(model: Column) -> Column:
    """A model's id without the number of its member."""
    return F.regexp_replace(model, r"_member\d+$", "")


def member_number(model: Column) -> Column:
    return F.nullif(F.regexp_extract(model, r"_member(\d+)$", 1), F.lit("")).cast("int")


def fair_crps(members: Column, observed: Column) -> Column:
    """Mean distance to the observation less half the unbiased mean distance between members.

    The sum over pairs comes from the sorted members, so that m members cost m log m instead of m squared.
    """
    x = F.array_sort(members)
    n = F.size(members)
    near = F.aggregate(members, F.lit(0.0), lambda s, v: s + F.abs(v - observed)) / n
    pairs = F.aggregate(F.transform(x, lambda v, i: (2 * i + 1 - n) * v), F.lit(0.0), lambda s, v: s + v)
    return near - pairs * 2 / (2 * n * F.greatest(n - 1, F.lit(1)))


def array_quantile(values: Column, q: float) -> Column:
    """Quantile of an array with linear interpolation."""
    return sorted_quantile(F.array_sort(values), q)


def sorted_quantile(x: Column, q: float) -> Column:
    """Quantile of an array in ascending order."""
    at = (F.size(x) - 1) * F.lit(float(q))
    low = F.floor(at).cast("int")
    a = F.get(x, low)
    return a + (F.coalesce(F.get(x, low + 1), a) - a) * (at - low)


def freezing_level(bottom: Column, top: Column, z_bottom: float = BOTTOM_M, z_top: float = TOP_M, sigma: float = SIGMA_C) -> tuple[Column, Column, Column, Column]:
    """(height of 0 degrees, lower, upper, regime) from two temperatures; no height in an inversion."""
    dz, drop = z_top - z_bottom, bottom - top
    d = F.when(drop > 0, drop)
    height = z_bottom + dz * bottom / d
    spread = abs(dz) * sigma / (d * d) * F.sqrt(top * top + bottom * bottom)
    regime = F.when(d.isNull(), "inversion").when(height < z_bottom, "below").when(height > z_top, "above").otherwise("interp")
    return height, height - spread, height + spread, regime


def shows_band(height: Column, lower: Column, upper: Column, regime: Column, z_bottom: float = BOTTOM_M, z_top: float = TOP_M) -> Column:
    """Whether an estimate is tight and near enough to be shown: a band of at most 500 m, at most 700 m above or 500 m below the stations."""
    near = F.when(regime == "above", height <= z_top + 700).when(regime == "below", height >= z_bottom - 500).otherwise(regime == "interp")
    return F.coalesce(near & (upper - lower <= 500), F.lit(False))


def circular_mean(degrees: Column) -> Column:
    """Aggregate: mean direction, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(F.sum(F.sin(F.radians(degrees))), F.sum(F.cos(F.radians(degrees))))), F.lit(360.0))


def compass(degrees: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in COMPASS]), F.pmod(F.round(degrees / 45), F.lit(8)).cast("int"))


def ordinal(n: Column) -> Column:
    ten, hundred = F.pmod(n, F.lit(10)), F.pmod(n, F.lit(100))
    suffix = F.when(hundred.between(11, 13), "th").when(ten == 1, "st").when(ten == 2, "nd").when(ten == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def signed(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%+.{digits}f", value)


def age_text(seconds: Column) -> Column:
    minutes = F.round(seconds / 60).cast("long")
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).when(minutes < 2880, F.concat(F.round(minutes / 60).cast("long").cast("string"), F.lit(" h"))).otherwise(F.concat(F.round(minutes / 1440).cast("long").cast("string"), F.lit(" d")))


def is_stale(ts: Column, now: Column, hours: float) -> Column:
    return F.unix_seconds(now) - F.unix_seconds(ts) > hours * 3600


def frame_key(camera: Column, ts: Column) -> Column:
    return F.concat(camera, F.lit("/"), F.date_format(ts, "yyyy/MM/dd/HHmm"), F.lit(".jpg"))


def frame_time(key: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(key, r"(\d{4}/\d{2}/\d{2}/\d{4})\.jpg$", 1), F.lit("yyyy/MM/dd/HHmm"))


def chance_text(p: Column) -> Column:
    """Words for a p-value; null where there was too little to test."""
    said = lambda words: F.concat(F.lit(f"{words} (p = "), p.cast("string"), F.lit(")"))
    return F.when(p.isNull(), "too few winters to test").when(p < 0.05, said("unlikely to be chance")).when(p < 0.1, said("borderline, it could be chance")).otherwise(said("could easily be chance"))


def content_id(*columns: Column) -> Column:
    """md5 over values, in hex; a null differs from an empty text."""
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]))
