"""Joins in time: nearest and backward as-of joins, trailing ranges, circular windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(first: Column, last: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(first / width), F.floor(last / width)))


def in_buckets(df: DataFrame, at: Column, width: int, before: int, after: int) -> DataFrame:
    """df with each row in the bucket of time it lies in (`__own`) and in those whose rows look back at it, at most `before`, or ahead, at most `after`.

    A frame over a group and `__b` then sees all that the rows with `__own` need, so a long series is many tasks.
    """
    return df.withColumn("__b", _buckets(at - after, at + before, width)).withColumn("__own", F.col("__b") == F.floor(at / width))


def _asof(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], tolerance_s: int, back_only: bool) -> DataFrame:
    """One row for each distinct (by, left time) that has a match, with the best right row's columns in `__r`.

    Times are dealt into buckets a few tolerances wide, the right side's also into those that look at them, so no single task holds a whole
    series, and a series that is a third of all rows is spread over its buckets. Within a bucket both sides stand in one order,
    where the last right row before a time and the first after it are carried along: no time meets every row within the tolerance.
    """
    tol = tolerance_s * 1_000_000
    width = max(8 * tol, 1)
    keyed = lambda df, on: df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in [*by, on]]))
    t, r = F.unix_micros(left_on), F.unix_micros(right_on)
    found = keyed(right, right_on).select(*by, r.alias("__t"), F.struct(*[c for c in right.columns if c not in by]).alias("__r"))
    found = found.select(*by, "__t", F.lit(None).cast(left.schema[left_on].dataType).alias(left_on), "__r", _buckets(F.col("__t") - (0 if back_only else tol), F.col("__t") + tol, width).alias("__b"))
    times = keyed(left, left_on).select(*by, left_on).distinct()
    times = times.select(*by, t.alias("__t"), left_on, F.lit(None).cast(found.schema["__r"].dataType).alias("__r"), F.floor(t / width).alias("__b"))
    both = found.unionByName(times)
    asked, place = F.col(left_on).isNotNull(), Window.partitionBy(*by, "__b")
    carried = lambda *order: F.last("__r", ignorenulls=True).over(place.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("__before", carried("__t", asked))
    gap = lambda c: F.abs(F.col("__t") - F.unix_micros(F.col(c)[right_on]))
    best = F.when(gap("__before") <= tol, F.col("__before"))
    if not back_only:
        both = both.withColumn("__after", carried(F.desc("__t"), asked))
        best = F.when((gap("__after") <= tol) & (gap("__before").isNull() | (gap("__after") < gap("__before"))), F.col("__after")).otherwise(best)
    return both.where(asked).select(*by, left_on, best.alias("__r")).where("__r is not null")


def nearest_asof(left: DataFrame, right: DataFrame, *, left_on: str, right_on: str, by: list[str] | None = None, tolerance_s: int = 1800, how: str = "inner") -> DataFrame:
    """left with the columns of the right row nearest in time, at most the tolerance away; of equals the earlier.

    Many left rows share one time, so only distinct times are matched, and the match is joined back.
    """
    by = by or []
    best = _asof(left, right, left_on, right_on, by, tolerance_s, False)
    return left.join(best, [*by, left_on], how).select(*left.columns, *[F.col("__r")[c].alias(c) for c in right.columns if c not in by])


def backward_asof(left: DataFrame, right: DataFrame, *, left_on: str, right_on: str, by: list[str] | None = None, tolerance_s: int = 1800, how: str = "left") -> DataFrame:
    """left with the columns of the newest right row not later than its time, at most the tolerance earlier."""
    by = by or []
    best = _asof(left, right, left_on, right_on, by, tolerance_s, True)
    return left.join(best, [*by, left_on], how).select(*left.columns, *[F.col("__r")[c].alias(c) for c in right.columns if c not in by])


def trailing_mean(df: DataFrame, *, value: str, happened: str, asked: str, by: list[str], window_days: int, min_n: int, out: str) -> DataFrame:
    """df plus, for each row, the mean of `value` over the rows of its group whose `happened` lies in the window of days before its `asked`.

    Strictly causal: what happens at `asked` is not in. Null with fewer than min_n rows. One pass over the
    union of happenings and questions, ordered within buckets of time a few windows wide.
    """
    seconds = F.unix_seconds
    span = window_days * 86_400
    events = df.select(*by, seconds(F.col(happened)).alias("__t"), F.col(value).alias("__v"))
    questions = df.select(*by, seconds(F.col(asked)).alias("__t")).distinct().withColumn("__v", F.lit(None).cast("double"))
    both = events.withColumn("__q", F.lit(False)).unionByName(questions.withColumn("__q", F.lit(True)))
    both = in_buckets(both, F.col("__t"), 4 * span, span, 0).where(F.col("__own") | ~F.col("__q"))
    w = Window.partitionBy(*by, "__b").orderBy("__t").rangeBetween(-span, -1)
    both = both.withColumn("__m", F.when(F.count("__v").over(w) >= min_n, F.avg("__v").over(w))).where("__q").select(*by, "__t", F.col("__m").alias(out))
    return df.withColumn("__t", seconds(F.col(asked))).join(both, [*by, "__t"], "left").drop("__t")


def around_day(df: DataFrame, day: str, window: int, out: str, period: int = 365) -> DataFrame:
    """Each row once for every day of the year within the window, wrapping at the year's end."""
    offsets = F.explode(F.sequence(F.lit(-window), F.lit(window)))
    return df.withColumn("__o", offsets).withColumn(out, F.pmod(F.col(day) + F.col("__o") - 1, F.lit(period)) + 1).drop("__o")
