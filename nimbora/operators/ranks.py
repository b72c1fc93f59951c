"""Exact ranks and quantiles of groups of any size: values are counted, dealt by sampled ranges, and placed by running sums."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbora.session import stored

RANGE_VALUES = 1 << 20  # distinct values of a range, on average


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys are equal; the left side's keys stay."""
    other = right.withColumnsRenamed({k: f"__on_{k}" for k in on})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__on_{k}")) for k in on])
    return left.join(other, same, how).drop(*[f"__on_{k}" for k in on])


def number(name: str) -> Column:
    """Whether a column holds a finite number."""
    inf = float("inf")
    return F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(F.col(name)) != F.lit(inf))


def _splits(counts: DataFrame, keys: Sequence[str], values: int) -> DataFrame:
    """(keys, __splits): some of each key's distinct values in order, one of `values` on average; of small keys mostly none."""
    some = counts.where(F.pmod(F.xxhash64(*keys, "__x"), F.lit(values)) == 0)
    return some.groupBy(*keys).agg(F.sort_array(F.collect_list("__x")).alias("__splits"))


def _dealt(df: DataFrame, splits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the number of the range in which __x lies."""
    place = F.coalesce(F.size(F.filter("__splits", lambda s: s <= F.col("__x"))), F.lit(0))
    return _joined(df, splits, keys, "left").withColumn("__r", F.when(F.col("__splits").isNull(), 0).otherwise(place)).drop("__splits")


def _totals(dealt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, __r, __in, __before, __all): how many lie in each range, in those below it and in all."""
    sums = dealt.groupBy(*keys, "__r").agg(F.sum("__n").alias("__in"))
    w = Window.partitionBy(*keys)
    before = F.sum("__in").over(w.orderBy("__r")) - F.col("__in")
    return sums.withColumns({"__before": before, "__all": F.sum("__in").over(w)})


def percentile_rank(values: DataFrame, reference: DataFrame, keys: Sequence[str], value: str = "v", ref: str = "ref", range_values: int = RANGE_VALUES) -> DataFrame:
    """values plus pct: the share of the reference with the same keys that lies below, ties as half.

    Every row stays, equal ones each; pct is null for a value that is no finite number and where there is nothing
    to compare with, null keys included. The references are counted by distinct value before they are shuffled. A key's distinct values are dealt by
    ranges between values that a hash picks, so one key is many tasks: a running sum within the range, what lies in the
    ranges below, and no work that grows with rows times references. Both sides are written before they meet: a mean that two
    branches of a plan compute may differ in its last bit from one to the other.
    """
    counts = reference.where(number(ref)).groupBy(*keys, (F.col(ref).cast("double") + 0.0).alias("__x")).agg(F.count("*").alias("__n"))
    counts = stored(counts, "references")
    rows = stored(values.withColumn("__x", F.when(number(value), F.col(value).cast("double") + 0.0)), "ranked")
    asked = rows.where("__x is not null").select(*keys, "__x").distinct().withColumn("__n", F.lit(0).cast("long"))
    splits = _splits(counts, keys, range_values)
    dealt = _dealt(counts.unionByName(asked), splits, keys).groupBy(*keys, "__r", "__x").agg(F.sum("__n").alias("__n"))
    below = F.sum("__n").over(Window.partitionBy(*keys, "__r").orderBy("__x")) - F.col("__n")
    placed = dealt.withColumn("__below", below).join(_totals(_dealt(counts, splits, keys), keys).select(*keys, "__r", "__before", "__all"), [*keys, "__r"], "left")
    # each range but the lowest holds the reference it begins with, so where there is none, none lies below
    every = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    share = (F.coalesce("__before", F.lit(0)) + F.col("__below") + 0.5 * F.col("__n")) * 100.0 / F.col("__total")
    found = placed.join(every, list(keys)).select(*keys, "__x", share.alias("pct"))
    return rows.join(found, [*keys, "__x"], "left").select(*values.columns, "pct")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], range_values: int = RANGE_VALUES) -> DataFrame:
    """(keys, q, n): exact quantiles with linear interpolation of the values that are not null, and how many there are.

    Values are counted before they are shuffled, and dealt by ranges as in percentile_rank. The ranges' totals say in which of them the wanted ranks lie, and only the values
    of these are put in order; so no task holds a group, however large. NaN stands above all numbers. Groups without a value are left out.
    """
    own = list(keys) or ["__g"]
    df = df if keys else df.withColumn("__g", F.lit(0))
    counts = df.where(F.col(value).isNotNull()).groupBy(*own, (F.col(value).cast("double") + 0.0).alias("__x")).agg(F.count("*").alias("__n"))
    counts = stored(counts, "values")
    dealt = _dealt(counts, _splits(counts, own, range_values), own)
    at = [(F.col("__all") - 1) * F.lit(float(p)) for p in probabilities]
    low = [F.floor(a) for a in at]
    high = [F.ceil(a) for a in at]
    wanted = F.array(*low, *high)
    inside = lambda first, n: F.exists(wanted, lambda rank: (rank >= first) & (rank < first + n))
    ranges = _totals(dealt, own).where(inside(F.col("__before"), F.col("__in")))
    few = _joined(dealt, ranges.select(*own, "__r", "__before", "__all"), [*own, "__r"])
    first = F.col("__before") + F.sum("__n").over(Window.partitionBy(*own, "__r").orderBy("__x")) - F.col("__n")
    few = few.withColumn("__first", first)
    here = lambda rank: F.max(F.when((rank >= F.col("__first")) & (rank < F.col("__first") + F.col("__n")), F.col("__x")))
    columns = [here(rank).alias(f"__{side}{i}") for side, ranks in (("l", low), ("h", high)) for i, rank in enumerate(ranks)]
    got = few.groupBy(*own).agg(*columns, F.max("__all").alias("__all"))
    q = [F.when(F.col(f"__l{i}") == F.col(f"__h{i}"), F.col(f"__l{i}")).otherwise(F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * (a - F.floor(a))) for i, a in enumerate(at)]
    return got.select(*keys, F.array(*q).alias("q"), F.col("__all").alias("n"))
