"""Seeded rounds dealt to tasks: the draws of numpy's default generator by place, the same for any number of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.session import stored

ROUNDS = 250  # of a group that one task does
_WORDS = 1 << 20  # looked at together
_LOW = np.uint64(0xFFFFFFFF)

#: The bounds of the draws with the given numbers.
Bounds = Callable[[np.ndarray], np.ndarray]


def words(seed: int, start: int, count: int) -> np.ndarray:
    """32-bit words of the generator from the given place on, without those before."""
    bits = np.random.PCG64(seed)
    bits.advance(start // 2)
    return bits.random_raw((start % 2 + count + 1) // 2).astype("<u8").view("<u4")[start % 2 :][:count].astype(np.uint64)


def _products(drawn: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that words give below their bounds, and which words the generator would throw away."""
    bounds = bounds.astype(np.uint64)
    product = drawn * bounds
    return (product >> np.uint64(32)).astype(np.int64), (product & _LOW) < (np.uint64(2**32) - bounds) % bounds


def thrown_away(seed: int, bounds: Bounds, draws: int) -> list[int]:
    """Places of the words, about one in 2^32 / bound, that are thrown away in the course of so many draws."""
    places, done = [], 0
    while done < draws:
        count = min(draws - done, _WORDS)
        bad = np.flatnonzero(_products(words(seed, done + len(places), count), bounds(done + np.arange(count)))[1])
        if len(bad):
            count = int(bad[0])
            places.append(done + len(places) + count)
        done += count
    return places


def draws_at(seed: int, bounds: Bounds, first: int, count: int, thrown: Sequence[int]) -> np.ndarray:
    """Draws first to first + count of the generator, one bound after another, where thrown is what thrown_away gives."""
    start, thrown = first, sorted(thrown)
    for place in thrown:
        start += place <= start
    inside, end = [], start + count
    for place in thrown:
        if start < place < end:
            inside.append(place - start)
            end += 1
    kept = np.delete(words(seed, start, end - start), inside)
    return _products(kept, bounds(first + np.arange(count)))[0]


class Picks:
    """Draws with replacement: each round has a row of `size` draws below `below` for each of several parts, one part after another.

    A part with one choice takes nothing from the generator.
    """

    def __init__(self, seed: int, n_rounds: int, parts: Sequence[tuple[int, int]]):
        self.seed, self.parts = seed, [(int(size), int(below)) for size, below in parts]
        self.starts = np.cumsum([0] + [n_rounds * size if below > 1 else 0 for size, below in self.parts])

    def bounds(self, numbers: np.ndarray) -> np.ndarray:
        return np.array([below for _, below in self.parts])[np.searchsorted(self.starts, numbers, "right") - 1]

    def thrown_away(self) -> list[int]:
        return thrown_away(self.seed, self.bounds, int(self.starts[-1]))

    def rows(self, part: int, first: int, count: int, thrown: Sequence[int]) -> np.ndarray:
        """(rounds, size) draws of a part for the rounds first to first + count."""
        size, below = self.parts[part]
        if below == 1:
            return np.zeros((count, size), np.int64)
        return draws_at(self.seed, self.bounds, int(self.starts[part]) + first * size, count * size, thrown).reshape(count, size)


def resampled(
    groups: DataFrame, by: Sequence[str], parts: Column, n_rounds: int, seed: int, block: Callable[[np.ndarray, Callable[[int], np.ndarray]], np.ndarray],
    finish: Callable[[np.ndarray, np.ndarray], dict], columns: str,
) -> DataFrame:
    """(by, columns) of a bootstrap over groups(by, rows), whose rounds are dealt to tasks by ROUNDS.

    `parts` are the (size, below) of a round's draws. `block` gets a group's rows and the draws of some rounds by
    part and gives a row of numbers for each round; `finish` gets a group's rows and all rounds' numbers in order.
    What is thrown away is found once for each distinct `parts`; a block starts at its own place in the generator.
    The tasks of a group send their rounds' numbers, and the group's rows once, to where they meet.
    """
    groups = stored(groups.select(*by, "rows", parts.alias("parts")), "groups")
    pairs = lambda flat: [tuple(p) for p in np.asarray(flat).reshape(-1, 2)]

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(thrown=[Picks(seed, n_rounds, pairs(p)).thrown_away() for p in frame.parts])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = []
            for rows, flat, thrown, first in zip(frame.rows, frame.parts, frame.thrown, frame["first"], strict=True):
                picks, count = Picks(seed, n_rounds, pairs(flat)), min(ROUNDS, n_rounds - first)
                values.append(np.asarray(block(np.stack(rows), lambda part: picks.rows(part, first, count, thrown)), float).ravel())  # noqa: B023
            yield frame[[*by, "first", "own"]].assign(values=values)

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in columns.split(", ")]
        for frame in frames:
            out = [finish(np.stack(own), np.concatenate([p["values"] for p in done]).reshape(n_rounds, -1)) for own, done in zip(frame.own, frame.done, strict=True)]
            yield pd.concat([frame[list(by)].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in groups.select(*by).schema)
    known = groups.select("parts").distinct().mapInPandas(find, "parts array<bigint>, thrown array<bigint>")
    tasks = groups.join(known, "parts").withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(n_rounds - 1), F.lit(ROUNDS))))
    tasks = tasks.repartition(*by, "first").withColumn("own", F.when(F.col("first") == 0, F.col("rows")))
    done = tasks.mapInPandas(run, f"{fields}first int, own array<array<double>>, values array<double>")
    met = done.groupBy(*by).agg(F.first("own", ignorenulls=True).alias("own"), F.array_sort(F.collect_list(F.struct("first", "values"))).alias("done"))
    return met.mapInPandas(meet, f"{fields}{columns}")
