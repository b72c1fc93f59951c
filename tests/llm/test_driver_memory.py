"""The driver gives back the memory that it holds free."""

import re
import time

import pytest

import corpus_pipeline
from nimbora.llm import quality, secret_scan
from nimbora.llm.common import let_go_driver


def test_native_memory_goes_back(spark):
    """150 MB in pieces below the end of the JVM's native heap, where freeing alone gives nothing back."""
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: int(re.search(r"Anonymous:\s+(\d+)", open(f"/proc/{pid}/smaps_rollup").read())[1]) / 1024
    let_go_driver(spark)
    pieces = [jvm.java.nio.ByteBuffer.allocateDirect(100_000) for _ in range(1500)]
    last, pieces = pieces[-1], None
    jvm.System.gc()
    time.sleep(1)
    freed = held()
    let_go_driver(spark)
    assert last.capacity() == 100_000 and freed - held() > 60


@pytest.fixture
def let_go(monkeypatch):
    """Whatever lets go of the driver's memory says so here."""
    said = []
    for module in (corpus_pipeline, quality, secret_scan):
        monkeypatch.setattr(module, "let_go_driver", lambda spark, m=module.__name__: said.append(m), raising=False)
    return said


def test_stages_begin_with_a_driver_that_let_go(spark, no_documents, let_go, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        let_go.clear()
        stage(spark, no_documents, f"file://{tmp_path}")
        assert let_go[:1] == ["corpus_pipeline"]


def test_models_let_go_of_what_they_are_made_from(spark, no_documents, let_go):
    quality.keep_good(no_documents, spark.createDataFrame([], "doc_id long, quality int"))
    assert let_go == ["nimbora.llm.quality"]
    secret_scan.SecretForest.of_corpus(no_documents)
    assert let_go[1:] == ["nimbora.llm.secret_scan"] * 2  # after the words, after the training
