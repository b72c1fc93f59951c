import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbora.llm import fill_in_middle as fim

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("values, most", [([], 0), ([1], 1), ([1, 2, 3], 3), ([5, 9, 1000], 1000), (list(range(1, 3000, 7)), 3000), ([10**9], 10**9), ([1, 10**6], 10**6)])
def test_lists_give_back_their_numbers(values, most):
    found = fim.EliasFano.from_bytes(fim.EliasFano.encode(np.array(values, np.int64), most).to_bytes())
    assert len(found) == len(values)
    assert [found[i] for i in range(len(found))] == values
    with pytest.raises(IndexError):
        found[len(values)]


def test_lists_are_small():
    ends = np.cumsum(np.random.default_rng(1).integers(40, 120, 10_000))
    assert len(fim.EliasFano.encode(ends, int(ends[-1])).to_bytes()) < 10_000 * 9 / 8


def by_hand(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text):
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < 50:
        return len(lines), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(lines), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def compared(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    out = fim.fill_in_middle(df)
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: (x[0] is None, x[0] or 0, repr(x[1:]))
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got], key=key) == sorted([(d, *by_hand(d, t), t or "") for d, t in rows], key=key)


def test_odd_documents(odd_documents, no_documents):
    compared(odd_documents)
    assert fim.fill_in_middle(no_documents).count() == 0


def test_odd_texts(spark):
    texts = ["a\n\n\nb", "\n", "\n\n", "no line", "ends\n", "é\n漢字\n😀 x\r\ny", "has <P> in it\nmore", "x<S>\ny", "<M>", "almost <\nS>\n<P\n>", "<\n<\n<", "a\n" * 5000, "l" * 200_000, "nul \0\n \0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 9)] + [(None, "a\nb\nc")] * 5 + [(None, None)] * 3, "doc_id long, text string").repartition(4)
    compared(df)


def test_a_text_that_most_rows_share(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("one\ntwo\nthree\n" * 20)).otherwise(F.concat(F.lit("own\n"), F.col("id").cast("string"))).alias("text"))
    compared(df)


def test_rate_and_order(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\nd").alias("text"))
    assert {r.form for r in fim.fill_in_middle(df, rate=0).collect()} == {"plain"}
    assert {r.form for r in fim.fill_in_middle(df, spm=100).collect()} == {"spm"}
    assert {r.form for r in fim.fill_in_middle(df, rate=50).collect()} == {"plain", "psm", "spm"}


def test_query_equals_sql(spark):
    got = fim.op12_fill_in_middle(spark, ROOT)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{ROOT}/documents.parquet'")
    want = con.execute(fim.SQL)
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
