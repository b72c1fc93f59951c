"""What the training-data operators share: table access, the shared folder, word hashes, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.session import new_folder, shared_folder  # noqa: F401  operators take new_folder from here

#: White space that ends a word, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df as a reliable checkpoint, so that a lost executor costs no recomputation of what came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key with more than this part of all rows is joined by broadcast; there are fewer such keys than this.
HEAVY_PARTS = 1000


def join_facts(rows: DataFrame, facts: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """rows joined with facts, which has one row a key and in column `count` how many of the `total` rows the key has.

    Keys with more than a thousandth of all rows, fewer than 1,000 whatever the size of the data, are broadcast, so
    that no key makes one large task; all others meet by an equi-join.
    """
    heavy = F.col(count) * HEAVY_PARTS > total
    some = rows.join(F.broadcast(facts.where(heavy)), on)
    return some.unionByName(rows.join(F.broadcast(facts.where(heavy).select(*on)), on, "left_anti").join(facts.where(~heavy), on))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


# ---- hashes of words and word sequences in numpy, for use inside tasks ----

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE_BASE, _WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SEEDS = np.random.default_rng(20240501).integers(0, 2**64, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and the offsets at which each text's words begin (with the end)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _IS_SPACE[buf]
    prev = np.empty_like(space)
    prev[0], prev[1:] = True, space[:-1]
    starts = np.flatnonzero(~space & prev)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    offsets = np.concatenate([[0], np.searchsorted(starts, text_ends)]).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    ends = np.flatnonzero(space & ~prev)
    inside = np.flatnonzero(~space)
    letters = buf[inside]
    if lower:
        letters = _ASCII_LOWER[letters]
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    values = _SEEDS[letters] * powers(_BYTE_BASE, int(lengths.max()))[place]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64)), offsets


def word_keys(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, with other values: words are read eight bytes at a time. Longer ones than 64 bytes have their word_hashes."""
    buf = np.frombuffer(b"\n".join([b"", *texts]) + b"\n" + bytes(8), np.uint8)
    if lower:
        buf = _ASCII_LOWER[buf]
    space = _IS_SPACE[buf[:-8]]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts]) + 1
    offsets = np.concatenate([[0], np.searchsorted(starts, text_ends)]).astype(np.int64)
    eight = np.ndarray(len(buf) - 7, np.dtype("<u8"), buf, strides=(1,))
    lengths = ends - starts
    keys = mix((eight[starts] & _FIRST_BYTES[np.minimum(lengths, 8)]) * _BYTE_BASE + lengths.astype(np.uint64))
    more = np.flatnonzero(lengths > 8)
    for at in range(8, 64, 8):
        if not len(more):
            return keys, offsets
        keys[more] = mix(keys[more] * _WORD_BASE + (eight[starts[more] + at] & _FIRST_BYTES[np.minimum(lengths[more] - at, 8)]))
        more = more[lengths[more] > at + 8]
    if len(more):
        keys[more] = word_hashes([buf[a:b].tobytes() for a, b in zip(starts[more], ends[more], strict=True)])[0]
    return keys, offsets


def sorted_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the stable order that sorts 64-bit hashes, the sorted hashes).

    numpy sorts values several times as fast as it finds their order, so the places stand in the last bits of what is
    sorted. The few hashes that agree in all bits before those are put in order after that.
    """
    n = len(keys)
    bits = np.uint64(n.bit_length())
    low = np.uint64((1 << int(bits)) - 1)
    both = (keys & ~low) | np.arange(n, dtype=np.uint64)
    both.sort()
    order = (both & low).astype(np.int64)
    out = keys[order]
    wrong = np.flatnonzero(out[1:] < out[:-1])
    if len(wrong):
        both >>= bits
        group = np.cumsum(np.concatenate([[False], both[1:] != both[:-1]]))
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[wrong]] = True
        some = np.flatnonzero(mixed[group])
        order[some] = order[some][np.argsort(out[some], kind="stable")]
        out = keys[order]
    return order, out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes, a place of each, the number among them of each key)."""
    order, keys = sorted_places(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return keys[new], order[new], inverse


def gram_hashes(hashes: np.ndarray, k: int, base: np.uint64 = _WORD_BASE) -> np.ndarray:
    """Hashes of the k-word sequences that start at each place (len(hashes) - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * base + hashes[j : j + n]
    return mix(out)


def pieces_of(texts: list[bytes], most: int = 1 << 20):
    """Runs of texts of about `most` bytes together (or one longer text), as (first, last) places."""
    at, room = 0, 0
    for i, t in enumerate(texts):
        if i > at and room + len(t) > most:
            yield at, i
            at, room = i, 0
        room += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


# ---- memory of workers ----


def let_go() -> None:
    """Gives the memory that a Python worker holds free back to the machine: workers live on after their tasks, beside other stages' needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def let_go_driver(spark: SparkSession) -> None:
    """The same on the driver, whose JVM keeps what training a model or planning took until it happens to collect its garbage.

    The JVM's native memory, which compiling leaves in pieces, goes back by the JVM's own command for it (jcmd's
    System.trim_native_heap); a JVM that has none keeps it.
    """
    let_go()
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    named = jvm.java.lang.Class.forName
    kinds, asked = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, (kind, value) in enumerate((
        ("javax.management.ObjectName", jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")),
        ("java.lang.String", "systemTrimNativeHeap"), ("[Ljava.lang.Object;", array(jvm.java.lang.Object, 0)), ("[Ljava.lang.String;", array(jvm.java.lang.String, 0)),
    )):
        kinds[i], asked[i] = named(kind), value
    with suppress(Py4JJavaError):  # by the interface: the server's own class is closed to calls from outside its module
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), asked)


@contextmanager
def no_cycles() -> Iterator[None]:
    """For work that makes very many lists and no reference cycles: the search for cycles, which would go through all of them over and over, pauses."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def tidy(run: Callable) -> Callable:
    """A function over batches that lets go of memory when its partition ends."""

    def tidied(frames):
        yield from run(frames)
        let_go()

    return tidied


# ---- ids of remembered words ----


class WordRows:
    """What words encode to: a row of ids for each word that is remembered, in flat arrays."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.start, self.again = self.length, np.zeros(0, bool)  # again: asked for by a later call than that which added it

    def add(self, ids: list[list[int]]) -> np.ndarray:
        """Appends rows; their numbers."""
        first = len(self.length)
        own = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(own) - own])
        self.length = np.concatenate([self.length, own])
        self.again = np.concatenate([self.again, np.zeros(len(own), bool)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(own.sum()))])
        return first + np.arange(len(ids))

    def of(self, words: list[str], encode: Callable[[list[str]], list[list[int]]]) -> np.ndarray:
        """The rows of words, of which those not yet known are encoded first."""
        found = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        self.again[found[found >= 0]] = True
        if len(new):
            fresh = [words[i] for i in new]
            found[new] = self.add(encode(fresh))
            self.rows |= zip(fresh, found[new].tolist(), strict=True)
        return found

    def keep(self, first: int = 0) -> None:
        """Forgets the words that no later call asked for again, the others have to be asked for anew; the first rows stay."""
        stay = self.again.copy()
        stay[:first] = True
        number, (flat, length) = np.cumsum(stay) - 1, self.gather(np.flatnonzero(stay))
        self.rows = {w: int(number[r]) for w, r in self.rows.items() if stay[r]}
        self.flat, self.length, self.start, self.again = flat, length, np.cumsum(length) - length, np.zeros(len(length), bool)

    def shrink(self, rows: int) -> None:
        """Forgets the rows from this number on."""
        self.flat = self.flat[: self.start[rows] if rows < len(self.start) else len(self.flat)]
        self.length, self.start, self.again = self.length[:rows], self.start[:rows], self.again[:rows]

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these rows one after another, how many each has)."""
        n = self.length[rows]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[rows] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n


def split_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(where each text's words begin, with the end; each word's place among the distinct words; these), cut at single spaces."""
    split = pc.split_pattern(column, " ")
    coded = split.flatten().dictionary_encode()
    offsets = split.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


# ---- packed columns, for shuffles of many small values ----


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as compressed byte planes, without the high planes that are all zero."""
    columns = [np.ascontiguousarray(c, np.uint64) for c in columns]
    widths = [(int(c.max(initial=0)).bit_length() + 7) // 8 for c in columns]
    planes = [np.ascontiguousarray(c.view(np.uint8)[i::8]) for c, w in zip(columns, widths, strict=True) for i in range(w)]
    raw = b"".join([len(columns[0]).to_bytes(8, "little"), bytes(widths), *planes])
    return len(raw).to_bytes(8, "little") + bytes(pa.compress(raw, codec="zstd", asbytes=True))


def unpack(data: bytes, columns: int) -> list[np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    n, at = int.from_bytes(raw[:8].tobytes(), "little"), 8 + columns
    out = [np.zeros(n, np.uint64) for _ in range(columns)]
    for c, width in zip(out, raw[8:at].tolist(), strict=True):
        for i in range(width):
            c.view(np.uint8)[i::8] = raw[at : at + n]
            at += n
    return out


# ---- connected components ----


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Alternating large-star and small-star steps: each is one aggregation and one equi-join, the
    number of rounds grows with the logarithm of the longest path, and each round is checkpointed.
    """

    def facts(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e)
    before = facts(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.unionByName(least.withColumnRenamed("m", "v")).distinct())
        now = facts(e)
        if now == before:
            centres = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
        before = now
