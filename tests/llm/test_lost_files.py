"""A model and a store whose files go, or are read in part."""

import glob
import os

import public_tokenizers
import pytest

from nimbora.llm import kneser_ney, token_store


def test_a_lost_file_of_the_model_raises(spark):
    df = spark.createDataFrame([(i, f"one two {i % 7} three {i % 5} four") for i in range(200)], "doc_id long, text string")
    model = kneser_ney.fit_kneser_ney(df, 3)
    before = {r.doc_id: r.score for r in kneser_ney.score_texts(df, model).collect()}
    assert before == {r.doc_id: r.score for r in kneser_ney.score_texts(df, model).collect()}
    for level in ("words", "2", "3"):
        path = sorted(glob.glob(f"{model.folder}/{level}/*"))[0]
        os.rename(path, path + ".gone")
        with pytest.raises(Exception, match="is gone"):
            kneser_ney.score_texts(df, model).collect()
        os.rename(path + ".gone", path)
    assert before == {r.doc_id: r.score for r in kneser_ney.score_texts(df, model).collect()}


def test_places_filter_the_scan_of_codes(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = spark.createDataFrame([(i, f"word{i} and more of it " * 30) for i in range(300)], "doc_id long, text string").repartition(4)
    token_store.write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    got = token_store.tokens_at(spark, path, [0, 5, 5, 10**9])
    assert [r.place for r in got.orderBy("place").collect()] == [0, 5]
    plan = got._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line and "codes" in line)
    assert "In(part" in scan or "EqualTo(part" in scan
    assert token_store.tokens_at(spark, path, []).count() == token_store.tokens_at(spark, path, [10**9]).count() == 0
