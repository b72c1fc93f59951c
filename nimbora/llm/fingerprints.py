"""Document fingerprints: threshold-scaled sketches of word shingles. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nimbora.llm.common import new_folder, table, words_of

SHINGLE = 5
FRACTION = 1 / 8  # of the hash space that a sketch retains
DOCUMENT_FRACTION = 1 / 2  # of op10's sketches: 1/8 leaves too few hashes of texts of a few dozen words


def limit_of(fraction: float) -> int:
    """The signed 64-bit value below which the given fraction of all hashes lies."""
    return int(-(2**63) + round(fraction * 2**64)) if fraction < 1 else 2**63 - 1


def with_sketch(df: DataFrame, text: str, out: str, fraction: float = FRACTION, shingle: int = SHINGLE) -> DataFrame:
    """df plus `out`: the sorted distinct hashes of the text's shingles that lie below the fixed fraction.

    The limit depends on nothing but the fraction, so sketches merge by union and the sketch of a part is
    comparable with that of a much longer whole. A text of fewer words is one shingle. A text none of whose
    hashes lies below the limit keeps its smallest one, which is compared with other such texts only; null and
    blank texts have an empty sketch.
    """
    kept = df.columns
    h, n = F.col("__h"), F.size("__h")
    grams = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)]))
    df = df.select(*kept, F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)).alias("__h"))
    df = df.select(*kept, F.when(n >= shingle, grams).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")).alias("__g"))
    df = df.select(*kept, F.when(F.size("__g") == 0, F.col("__g")).otherwise(
        F.concat(F.filter("__g", lambda x: x < limit_of(fraction)), F.array(F.array_min("__g")))).alias("__g"))
    return df.select(*kept, F.array_sort(F.array_distinct("__g")).alias(out))


def _comparable(a: Column, b: Column, fraction: float) -> tuple[Column, Column]:
    """The hashes below the limit, or the smallest ones of two sketches that have none there."""
    inside = lambda x: F.filter(x, lambda h: h < limit_of(fraction))
    neither = (F.size(inside(a)) == 0) & (F.size(inside(b)) == 0)
    return F.when(neither, a).otherwise(inside(a)), F.when(neither, b).otherwise(inside(b))


def likeness(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated Jaccard similarity of two sketches of this fraction; two empty ones are alike."""
    x, y = _comparable(a, b, fraction)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of a's shingles that b has; an empty sketch is contained in everything.

    Null where a has no hash below the limit and b has: nothing of a can be looked up in b.
    """
    x, y = _comparable(a, b, fraction)
    return F.when(F.size(a) == 0, 1.0).when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.lit(1)))


def merge_sketches(df: DataFrame, by: list[str], sketch: str, fraction: float = FRACTION) -> DataFrame:
    """One sketch for each group: that of all its texts together. Hashes are pre-aggregated before the shuffle."""
    hashes = df.select(*by, F.explode(sketch).alias("__x")).distinct()
    inside = F.collect_list(F.when(F.col("__x") < limit_of(fraction), F.col("__x")))
    merged = hashes.groupBy(*by).agg(inside.alias("__in"), F.min("__x").alias("__least"))
    return merged.select(*by, F.when(F.size("__in") > 0, F.array_sort("__in")).otherwise(F.array("__least")).alias(sketch))


def as_text(sketch: Column) -> Column:
    """A sketch as a string: 16 hex digits for each hash, in order."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def next_keys(keys: DataFrame) -> DataFrame:
    """keys(rid, th) plus next_rid, next_th: the row that follows in the order rid descending, th ascending; the first follows the last.

    Keys are dealt by sampled ranges of that order, so that neither the spread of the ids nor a frequent one matters; only the
    first row of each range meets the others in one place.
    """
    spark = keys.sparkSession
    folder = new_folder(spark, "ordered-keys")
    dealt = keys.select("rid", "th").repartitionByRange(F.desc("rid"), F.asc("th"))
    dealt.withColumn("__part", F.spark_partition_id()).write.parquet(folder)
    keys = spark.read.parquet(folder)
    here = F.struct("rid", "th")
    own = keys.withColumn("__next", F.lead(here).over(Window.partitionBy("__part").orderBy(F.desc("rid"), "th")))
    tops = keys.groupBy("__part").agg(F.max(F.struct("rid", (-F.col("th").cast("decimal(20,0)")).alias("t"), "th")).alias("top"))
    tops = tops.select("__part", F.struct("top.rid", "top.th").alias("top"))
    parts = Window.orderBy("__part")  # one row a part
    across = tops.select("__part", F.lead("top").over(parts).alias("__after"), F.min_by("top", "__part").over(Window.partitionBy()).alias("__first"))
    nxt = F.coalesce("__next", "__after", "__first")
    return own.join(across, "__part").select("rid", "th", nxt["rid"].alias("next_rid"), nxt["th"].alias("next_th"))


def fingerprint_with_edits(documents: DataFrame, fraction: float = DOCUMENT_FRACTION) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses, as op10's contract states them.

    documents(doc_id, text). A null text is empty. A null doc_id orders after all others. Rows that share a
    doc_id are ordered by a hash of their texts; equal rows are one document in that order and all get its
    result. A single document is its own next one. An empty table gives an empty result.
    """
    base = documents.select(
        "doc_id", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("rid"), F.coalesce("text", F.lit("")).alias("text")
    )
    base = base.withColumn("th", F.xxhash64("text", F.isnull("doc_id")))
    keys = base.select("rid", "th", F.char_length("text").alias("n")).distinct()
    wants = next_keys(keys.select("rid", "th")).join(keys, ["rid", "th"])
    wants = wants.select(F.col("next_rid").alias("rid"), F.col("next_th").alias("th"), F.col("rid").alias("for_rid"), F.col("th").alias("for_th"), F.floor(F.col("n") / 3).cast("int").alias("k"))
    given = base.join(wants, ["rid", "th"])
    given = with_sketch(given, "text", "next_sketch", fraction)
    given = given.select(F.col("for_rid").alias("rid"), F.col("for_th").alias("th"), F.left("text", F.col("k")).alias("head"), "next_sketch", F.col("doc_id").alias("next_doc_id"))
    given = given.dropDuplicates(["rid", "th"])
    df = base.join(given, ["rid", "th"]).withColumn("n_chars", F.char_length("text"))
    df = df.withColumn("edited", F.concat(F.left("text", F.col("n_chars") - F.floor(F.col("n_chars") / 3).cast("int")), "head"))
    df = with_sketch(with_sketch(df, "text", "sketch", fraction), "edited", "edited_sketch", fraction)
    return df.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), fraction).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch"), fraction).alias("near_next"),
        "next_doc_id",
    )


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
