"""The pipeline against its decisions worked out one by one."""

import re
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from nimbora.llm import quality

from .conftest import text
from .test_operators import brute_hits


def test_pipeline(spark, tmp_path):
    rows = []
    for i in range(120):
        junk = i % 4 == 0
        body = " ".join(["SPAM!! BUY!!"] * 30) + f" {i}" if junk else text(*[(i * 37 + k * k * 3) % 2400 for k in range(70)])
        rows.append((i, body, "en", "src", len(body)))
    rows[5] = (5, rows[3][1], "en", "src", 1)  # a copy
    rows[6] = (6, rows[6][1] + " password=b7db7aa4a5fcc78305 end", "en", "src", 1)
    item = " ".join(rows[9][1].split()[20:40])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}

    scores = {r.doc_id: r.score for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()}
    left = {k: t for k, t, *_ in rows if scores[k] >= 0.5}
    left = {k: t for k, t in left.items() if t not in [left[j] for j in left if j < k]}
    left = {k: t for k, t in left.items() if not brute_hits(t, [(1, item)])[-1]}
    left = {k: re.sub("b7db7aa4a5fcc78305", "[REDACTED]", t) for k, t in left.items()}
    assert {k: r.text for k, r in got.items()} == left and 5 not in left and 9 not in left
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r.ids == lib.encode(r.text) for r in got.values())


def test_stages_are_named_in_order():
    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == ["quality", "n-gram", "benchmark", "secret", "SentencePiece"]


def test_stages_on_odd_documents(spark, odd_documents, no_documents, tmp_path):
    """Nulls, empty and long texts, repeated rows, no rows and clashing names, through every stage by itself."""
    extra = odd_documents.withColumns({"score": F.lit("s"), "secrets": F.lit(1), "contaminated": F.lit("c"), "n_chars": F.length("text").cast("long"), "n_hit": F.lit(None).cast("int")})
    spark.createDataFrame([(1, 1, 0), (11, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, text(*range(205, 230))), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stay = {"n-gram Jaccard join": 8, "benchmark decontamination": 11, "secret scans": 14, "SentencePiece encoding": 14}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, extra, f"file://{tmp_path}")
        assert got.columns[: len(extra.columns)] == extra.columns and len(got.columns) == len(extra.columns) + (name == "SentencePiece encoding")
        rows = got.collect()
        assert len(rows) == stay.get(name, len(rows)), name
        known = Counter(map(tuple, extra.collect()))
        assert not Counter(tuple(r)[: len(extra.columns)] for r in rows) - known, name
        assert stage(spark, no_documents, f"file://{tmp_path}").collect() == [], name
