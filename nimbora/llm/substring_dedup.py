"""Substring dedup: winnowed anchors are joined, extended both ways, and repeats of at least 50 words removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.llm.common import gram_hashes, join_facts, mix, new_folder, pieces_of, powers, table, word_hashes
from nimbora.llm.url_filter import bloom_filter, maybe_listed

WINDOW = 50  # words that a repeat has at least
SEED = 8  # words of an anchor
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_NO_ID = 2**63 - 1  # stands for a null id: after all others


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each place where `width` values follow, the place of the first smallest of them."""
    n = len(values) - width + 1
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        have += step
    return at[: max(n, 0)]


class Anchors:
    """The winnowed anchors of a batch of texts.

    Each run of 50 words of one text chooses its smallest 8-word hash, the first of equals, so equal runs choose
    the same place wherever they stand. Consecutive runs that choose one place make an anchor's context, the
    longest stretch of words around it that could be a repeat found by this anchor alone.
    """

    def __init__(self, texts: list[bytes]):
        self.hashes, self.offsets = word_hashes(texts)
        n = len(self.hashes)
        doc = np.repeat(np.arange(len(texts)), np.diff(self.offsets))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.hashes * powers(_BASE, n)[:n], dtype=np.uint64)])
        self.inverse = powers(_INVERSE, n + 1)
        if n < WINDOW:
            self.doc = self.place = self.first = self.last = np.zeros(0, np.int64)
            self.key = self.context = np.zeros(0, np.uint64)
            return
        seeds = gram_hashes(self.hashes, SEED)
        starts = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
        chosen = leftmost_minima(seeds, WINDOW - SEED + 1)[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])
        begins = np.flatnonzero(new)
        ends = np.concatenate([begins[1:], [len(starts)]]) - 1 if len(begins) else begins
        self.first, self.last = starts[begins], starts[ends]  # starts of the first and last run that chose it
        self.place, self.doc = chosen[begins], doc[starts[begins]]
        self.key = seeds[self.place]
        self.context = mix(self.span(self.first, self.last + WINDOW) + (self.place - self.first).astype(np.uint64))

    def span(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words in [first, end)."""
        return mix((self.sums[end] - self.sums[first]) * self.inverse[first])


def _texts(frame: pd.DataFrame) -> list[bytes]:
    return [t.encode("utf-8", "replace") for t in frame.text]


def _anchor_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = _texts(frame)
        for a, b in pieces_of(texts):
            x = Anchors(texts[a:b])
            yield pd.DataFrame({"key": x.key.view(np.int64), "context": x.context.view(np.int64), "did": frame.did.to_numpy()[a + x.doc]})


def _extended(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For the marked anchors of each text, every 50-word run around them."""
    for frame in frames:
        texts = _texts(frame)
        for a, b in pieces_of(texts):
            x = Anchors(texts[a:b])
            cut = np.searchsorted(x.doc, np.arange(b - a + 1))
            for i, marks in enumerate(frame.marks.iloc[a:b]):
                own = slice(cut[i], cut[i + 1])
                hit = np.flatnonzero(np.isin(x.context[own].view(np.int64), np.asarray(marks, np.int64))) + cut[i]
                if not len(hit):
                    continue
                count = x.last[hit] - x.first[hit] + 1
                start = np.repeat(x.first[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                yield pd.DataFrame({
                    "key": np.repeat(x.key[hit].view(np.int64), count), "run": x.span(start, start + WINDOW).view(np.int64),
                    "did": frame.did.iloc[a + i], "th": frame.th.iloc[a + i], "start": (start - x.offsets[i]).astype(np.int32),
                })


def _cut_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Covers the hit runs and keeps the other words."""
    for frame in frames:
        texts, rows = _texts(frame), []
        for a, b in pieces_of(texts):
            marked = [m is not None and len(m) > 0 for m in frame.marks.iloc[a:b]]
            x = Anchors(texts[a:b]) if any(marked) else None
            for i in range(a, b):
                words = texts[i].split()
                gone = np.zeros(len(words) + 1, np.int64)
                if marked[i - a]:
                    own = np.flatnonzero(x.doc == i - a)
                    own = own[np.isin(x.context[own].view(np.int64), np.asarray(frame.marks.iloc[i], np.int64))]
                    np.add.at(gone, x.first[own] - x.offsets[i - a], 1)
                    np.add.at(gone, x.last[own] - x.offsets[i - a] + WINDOW, -1)
                starts = frame.starts.iloc[i]
                if starts is not None and len(starts):
                    np.add.at(gone, np.asarray(starts), 1)
                    np.add.at(gone, np.asarray(starts) + WINDOW, -1)
                gone = np.cumsum(gone)[:-1] > 0
                kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if gone.any() else b" ".join(words)
                rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept"])
        out.insert(0, "did", frame.did.to_numpy())
        yield out


def _ids(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))


def find_repeats(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marks, runs): (did, contexts) of anchors all of whose runs repeat, and (did, th, starts) of single repeated runs.

    1. Seed: anchors are counted by (key, context); the smallest document of each context is its first.
       A later document with the same context repeats all of its runs.
    2. Extend: where a key has several contexts, the first document of each is extended to every 50-word run
       around the anchor, and the runs are counted by their words. Copies are represented by their first
       document here, so the work doesn't grow with the square of a group's size.
    All counts are pre-aggregated before they are shuffled, and no context, key or run makes one large task.
    """
    spark = documents.sparkSession
    base = _ids(documents)
    folder = new_folder(spark, "anchors")
    base.select("did", "text").mapInPandas(_anchor_rows, "key long, context long, did long").write.parquet(folder, compression="zstd")
    anchors = spark.read.parquet(folder)

    folder = new_folder(spark, "contexts")
    counted = anchors.groupBy("key", "context").agg(F.min("did").alias("first"), F.max("did").alias("most"), F.count("*").alias("n"))
    counted.write.parquet(folder, compression="zstd")
    contexts = spark.read.parquet(folder)
    shared = contexts.where("most > first").select("key", "context", "first", "n")
    marks = join_facts(anchors, shared, ["key", "context"], "n", anchors.count()).where("did > first").select("did", "context").distinct()
    marks = marks.groupBy("did").agg(F.collect_list("context").alias("marks"))

    several = contexts.groupBy("key").agg(F.count("*").alias("of_key")).where("of_key > 1")
    firsts = join_facts(contexts, several, ["key"], "of_key", contexts.count()).groupBy(F.col("first").alias("did")).agg(F.collect_set("context").alias("marks"))
    folder = new_folder(spark, "extend")
    firsts.write.parquet(folder)
    firsts = spark.read.parquet(folder)
    bloom, blocks = bloom_filter(firsts.select(F.col("did").cast("string").alias("key")), firsts.count())
    some = maybe_listed(base.withColumn("key", F.col("did").cast("string")), bloom, blocks).drop("key")
    folder = new_folder(spark, "runs")
    runs = some.join(firsts, "did").mapInPandas(_extended, "key long, run long, did long, th long, start int")
    runs.write.parquet(folder, compression="zstd")
    runs = spark.read.parquet(folder)
    least = runs.groupBy("key", "run").agg(F.min("did").alias("first"), F.max("did").alias("most"), F.count("*").alias("n")).where("most > first")
    folder = new_folder(spark, "repeated")
    least.select("key", "run", "first", "n").write.parquet(folder, compression="zstd")
    runs = join_facts(runs, spark.read.parquet(folder), ["key", "run"], "n", runs.count()).where("did > first")
    return marks, runs.groupBy("did", "th").agg(F.collect_set("start").alias("starts"))


def remove_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for each row of documents(doc_id, text).

    A word goes when it is covered by 50 consecutive words of its document that also stand in a document with
    a smaller doc_id; overlapping runs make one maximal repeat. Runs are judged on the input. A null text has
    no words. A null doc_id counts as larger than all others. Rows with one doc_id are never repeats of each
    other. An empty table gives an empty result.
    """
    marks, runs = find_repeats(documents)
    runs = runs.groupBy("did").agg(F.collect_list(F.struct("th", "starts")).alias("runs"))
    found = marks.withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType)).unionByName(runs.withColumn("marks", F.lit(None).cast("array<bigint>")))
    found = found.groupBy("did").agg(F.flatten(F.collect_list("marks")).alias("marks"), F.flatten(F.collect_list("runs")).alias("runs"))
    joined = _ids(documents).join(found, "did", "left")
    starts = F.flatten(F.transform(F.filter("runs", lambda r: r["th"] == F.col("th")), lambda r: r["starts"]))
    joined = joined.select("did", "text", "marks", starts.alias("starts"))
    out = joined.mapInPandas(_cut_out, "did long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.withColumn("doc_id", F.when(F.col("did") != _NO_ID, F.col("did"))).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
r AS (SELECT doc_id, s, hash(list_slice(w, s, s + 49)) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS s FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM r GROUP BY h),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(s, s + 49)) AS p FROM r JOIN f USING (h) WHERE first < doc_id)),
g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
k AS (SELECT d.doc_id, string_agg(d.w[d.p], ' ' ORDER BY d.p) AS kept FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d) d
      LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.p = d.p WHERE gone.p IS NULL GROUP BY d.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""
