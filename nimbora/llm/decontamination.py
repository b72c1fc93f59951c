"""Benchmark decontamination: a prefix-filtered join of item windows with documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.llm.common import lower_ascii, table

WINDOW = 10
#: Item windows up to this many are broadcast (tens of MB); beyond it the word join is dealt over the cluster.
BROADCAST_WINDOWS = 100_000


def item_words(text: Column) -> Column:
    """Lower-cased words: runs of a-z, 0-9 and characters beyond ASCII. Null has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(win, n, items): the distinct windows of all items and which items have them.

    An item of fewer words than a window is one window; null and wordless items have none.
    """
    items = benchmark.select("item_id", item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    cut = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win"))
    return cut.groupBy("win").agg(F.collect_set(F.col("item_id").cast("string")).alias("items")).withColumn("n", F.size("win"))


def _dealt(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= BROADCAST_WINDOWS else small


def with_prefixes(windows: DataFrame, documents: DataFrame, rows: int) -> DataFrame:
    """windows plus the token that a document must have to hold them, and its place in the window.

    Words are ordered by how rare they are in all documents. A window is held only if all of its words are, so
    its necessary prefix is one word: the rarest. Windows with a word that no document has are left out.
    """
    vocabulary = windows.select(F.explode("win").alias("word")).distinct()
    seen = documents.select(F.explode("w").alias("word")).join(_dealt(vocabulary, rows), "word").groupBy("word").agg(F.count("*").alias("df"))
    words = windows.select("win", "n", "items", F.posexplode("win").alias("at", "word"))
    ranked = words.join(seen, "word", "left").groupBy("win", "n", "items")
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "at"))
    return ranked.agg(rarest.alias("r")).where("r.df > 0").select("win", "n", "items", F.col("r.word").alias("word"), F.col("r.at").alias("at"))


def _in_place(words: DataFrame, probes: DataFrame) -> DataFrame:
    """(doc_id, __th, start, n, items) of windows found, with few probes: each is tried where its document is read."""
    places = words.select("doc_id", "__th", "w", F.posexplode("w").alias("pos", "word"))
    start = F.col("pos") - F.col("at")
    found = places.join(F.broadcast(probes), "word").where(start >= 0).where(start + F.col("n") <= F.size("w"))
    found = found.where(F.slice("w", F.greatest(start + 1, F.lit(1)), F.col("n")) == F.col("win"))
    return found.select("doc_id", "__th", start.alias("start"), "n", "items")


def _by_shuffle(words: DataFrame, probes: DataFrame) -> DataFrame:
    """The same with any number of probes: words meet them by a shuffle, and what fits is tried by document."""
    places = words.select("doc_id", "__th", F.size("w").alias("m"), "w").select("doc_id", "__th", "m", F.posexplode("w").alias("pos", "word"))
    start = F.col("pos") - F.col("at")
    tries = places.join(probes, "word").where(start >= 0).where(start + F.col("n") <= F.col("m"))
    tries = tries.groupBy(F.col("doc_id").alias("__id"), F.col("__th").alias("__h")).agg(F.collect_set(F.struct(start.alias("start"), "n", "win", "items")).alias("tries"))
    joined = words.dropDuplicates(["doc_id", "__th"]).join(tries, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h")))
    right = F.filter("tries", lambda t: F.slice("w", t["start"] + 1, t["n"]) == t["win"])
    return joined.select("doc_id", "__th", F.explode(right).alias("t")).select("doc_id", "__th", "t.start", "t.n", "t.items")


RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def without_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a window of an item, with all their columns as they were, also those that are named like results."""
    own = {c: f"__own_{i}" for i, c in enumerate(documents.columns) if c.lower() in RESULTS}
    found = contamination(documents.withColumnsRenamed(own), benchmark, window).where("not contaminated").drop(*RESULTS)
    return found.withColumnsRenamed({v: k for k, v in own.items()}).select(*documents.columns)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents plus n_words, n_hit, n_items, items_sha256 and contaminated, as op4's contract states them.

    Every occurrence of a window's rarest word proposes one place; length and position bounds drop those
    where the window would not fit in the document, and the words themselves are compared. Rows that share a
    doc_id and text get equal results. Null texts have no words. Without items nothing is hit. Columns of
    `documents` with the names of the results are replaced.
    """
    documents = documents.drop(*[c for c in documents.columns if c.lower() in RESULTS])
    windows = item_windows(benchmark, window)
    rows = windows.count()
    text_key = F.xxhash64("text")
    words = documents.select("doc_id", text_key.alias("__th"), item_words(F.col("text")).alias("w"))
    probes = with_prefixes(windows, words, rows)
    found = _in_place(words, probes) if rows <= BROADCAST_WINDOWS else _by_shuffle(words, probes)
    hits = found.groupBy("doc_id", "__th").agg(F.collect_set(F.struct("start", "n")).alias("spans"), F.collect_set("items").alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))))
    hits = hits.select(F.col("doc_id").alias("__id"), F.col("__th").alias("__hit_th"), covered.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    own = documents.withColumn("__th", text_key)
    joined = own.join(hits, own["doc_id"].eqNullSafe(hits["__id"]) & (own["__th"] == hits["__hit_th"]), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        *documents.columns, F.size(item_words(F.col("text"))).cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(documents, table(spark, sf_dir, "benchmark")).drop("text")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, list_slice(w, s, s + {WINDOW - 1}) AS win
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM iw),
dw AS (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS win
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, s, n, item_id FROM dw JOIN iw USING (win)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover ON d.doc_id = cover.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
