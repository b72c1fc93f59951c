"""Fill-in-middle: texts are cut at line ends that an index of the distinct texts holds as Elias-Fano lists."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.llm.common import HEAVY_PARTS, new_folder, table, tidy
from nimbora.llm.url_filter import bloom_filter, with_possibly

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
RATE = 100  # of 100 texts so many are cut
SPM = 50  # of 100 cut texts so many have the suffix first
STEP = 512  # bits of the upper bitmap between two entries of its directory

_TAG = re.compile("|".join((PREFIX, SUFFIX, MIDDLE)))
_FACTS = "did string, n long, form string, prefix_chars long, middle_chars long, output string"


class EliasFano:
    """An ascending list of numbers up to `most`: the lower bits of each in one array, the upper ones in unary in a bitmap.

    A list of n numbers takes 2 + log2(most / n) bits a number. The directory holds the number of set bits before every
    512th bit of the bitmap, so the number at a place is one search and one short count.
    """

    def __init__(self, n: int, width: int, low: bytes, high: bytes):
        self.n, self.width, self.low, self.high = n, width, low, high
        ones = np.bitwise_count(np.frombuffer(high, np.uint8)).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), STEP // 8)))]) if n else np.zeros(1, np.int64)

    @classmethod
    def encode(cls, values: np.ndarray, most: int) -> EliasFano:
        n = len(values)
        width = max(0, (most // n).bit_length() - 1) if n else 0
        values = values.astype(np.int64)
        low = (values[:, None] >> np.arange(width)) & 1
        high = np.zeros(n + (int(values[-1]) >> width) + 1 if n else 0, np.uint8)
        high[(values >> width) + np.arange(n)] = 1
        return cls(n, width, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes())

    def to_bytes(self) -> bytes:
        return self.n.to_bytes(8, "little") + bytes([self.width]) + self.low + self.high

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, width = int.from_bytes(data[:8], "little"), data[8]
        cut = 9 + (n * width + 7) // 8
        return cls(n, width, data[9:cut], data[cut:])

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.ranks, i, side="right")) - 1
        bits = np.unpackbits(np.frombuffer(self.high[block * STEP // 8 : (block + 1) * STEP // 8], np.uint8), bitorder="little")
        place = block * STEP + int(np.flatnonzero(bits)[i - self.ranks[block]])
        first = i * self.width
        lower = int.from_bytes(self.low[first // 8 : (first + self.width + 7) // 8], "little") >> first % 8 & ((1 << self.width) - 1)
        return (place - i) << self.width | lower


def line_ends(text: str) -> EliasFano:
    """Where the text's lines end, in code points; a line holds its line feed, the last one may have none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(codes == 10) + 1
    if len(codes) and codes[-1] != 10:
        ends = np.append(ends, len(codes))
    return EliasFano.encode(ends, len(codes))


def cut_text(text: str, ends: EliasFano, h: tuple[int, int, int, int], rate: int = RATE, spm: int = SPM) -> tuple[str, int | None, int | None, str]:
    """(form, prefix_chars, middle_chars, output) of a text under four seeded numbers."""
    if not text or h[2] % 100 >= rate or _TAG.search(text):
        return "plain", None, None, text
    a, b = sorted((h[0] % (len(ends) + 1), h[1] % (len(ends) + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (a, b))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def restored(output: Column, form: Column) -> Column:
    """The exact text from an output and its form. A tag can't begin within another one, so the first of each in its place is the one that was put in."""
    tag = len(PREFIX)
    after = lambda text, head: F.substr(text, F.length(head) + tag + 1)
    body = F.substr(output, F.lit(tag + 1))
    first = F.substring_index(body, SUFFIX, 1)
    rest = after(body, first)
    last = F.substring_index(rest, MIDDLE, 1)
    psm = F.concat(first, after(rest, last), last)
    first = F.substring_index(body, PREFIX, 1)
    rest = after(body, first)
    last = F.substring_index(rest, MIDDLE, 1)
    spm = F.concat(last, after(rest, last), first)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def _index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.assign(ends=[line_ends(t).to_bytes() for t in frame.text])


def _cut_rows(rate: int, spm: int):
    """Cuts rows (did, h, text) at the ends in their column `ends`, or where there is none at those found in the text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lists = map(EliasFano.from_bytes, frame.ends) if "ends" in frame else map(line_ends, frame.text)
            rows = [(did, len(ends), *cut_text(text, ends, tuple(h), rate, spm)) for did, h, text, ends in zip(frame.did, frame.h, frame.text, lists, strict=True)]
            out = pd.DataFrame(rows, columns=["did", "n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return tidy(run)


def fill_in_middle(documents: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of documents(doc_id, text).

    Every text is cut into n lines, and at two line ends that sha256 of "seed:doc_id" selects; the output has the three parts
    behind their tags. Texts that hold a tag, and empty ones, stay plain.

    The line ends of equal texts are found once: texts whose hash is there more than once (a blocked Bloom filter of at most 16 MB
    says so, and errs only towards "more than once") are grouped by their whole content, each gets its Elias-Fano list, and the
    documents join it by hash and SHA-256; all other texts are cut where they are read and never shuffled. A text
    that more than a thousandth of all rows share is dealt to as many tasks as its share is thousandths.

    A null text counts as empty, a null doc_id is seeded as "null". Equal rows get equal results, one each. An empty table gives
    an empty result.
    """
    spark = documents.sparkSession
    text, did = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    words = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(did, F.lit("null"))), 256)
    h = F.array(*[F.conv(F.substring(words, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])
    base = documents.select(did.alias("did"), text.alias("text"), F.xxhash64(text).alias("th"), h.alias("h"))

    folder = new_folder(spark, "fim-hashes")
    base.groupBy("th").agg(F.count("*").alias("n")).groupBy((F.col("n") > 1).alias("many"), F.when(F.col("n") > 1, F.col("th")).alias("th")).agg(F.sum("n").alias("n")).write.parquet(folder)
    counts = spark.read.parquet(folder)
    facts = counts.agg(F.sum("n"), F.count_if("many")).first()
    total, repeated = facts[0] or 0, facts[1] or 0
    bloom, blocks = bloom_filter(counts.where("many").select(F.col("th").cast("string").alias("key")), repeated)
    dealt = with_possibly(base.withColumn("key", F.col("th").cast("string")), bloom, blocks, "many").drop("key")

    alone = dealt.where("not many").select("did", "h", "text").mapInPandas(_cut_rows(rate, spm), _FACTS)
    copies = dealt.where("many")
    key = ["th", "digest"]
    texts = copies.groupBy("text", "th").agg(F.count("*").alias("n")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") * HEAVY_PARTS / F.lit(max(total, 1)))).cast("int")
    folder = new_folder(spark, "fim-index")
    texts.withColumn("salts", salts).drop("n").mapInPandas(_index, "text string, th long, digest binary, salts int, ends binary").write.parquet(folder, compression="zstd")
    index = spark.read.parquet(folder)
    heavy = F.broadcast(index.where("salts > 1").select(*key, "salts"))  # fewer than 1,000 rows of 44 bytes
    members = copies.select("did", "h", "th", F.unhex(F.sha2("text", 256)).alias("digest")).join(heavy, key, "left")
    spread = F.pmod(F.coalesce(F.xxhash64("did"), F.monotonically_increasing_id()), F.coalesce("salts", F.lit(1))).cast("int")
    members = members.select("did", "h", *key, F.when(F.col("salts").isNull(), 0).otherwise(spread).alias("salt"))
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    together = members.join(index, [*key, "salt"]).select("did", "h", "text", "ends").mapInPandas(_cut_rows(rate, spm), _FACTS)
    return alone.unionByName(together).select(F.col("did").cast("long").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


_H = ", ".join(f"('0x' || substr(s, {8 * i + 1}, 8))::UBIGINT::BIGINT AS h{i + 1}" for i in range(4))
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || doc_id::VARCHAR) AS s FROM documents),
u AS (SELECT doc_id, text, {_H}, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l FROM d),
c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(l[1:a], '') AS pre, array_to_string(l[a + 1:b], '') AS mid, array_to_string(l[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
