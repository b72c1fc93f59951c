"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.llm.common import join_facts, lower_ascii

#: Default list of blocked sites and pages: canonical host (no "www." or "m."), then "/" for a whole
#: site with its subdomains, or the path of one page without a closing "/".
BLOCKED = ("cheap-pills.example.com/", "spam-farm.example.org/", "casino-bonus.example.net/", "free-money.example.com/")
#: (verdict, rule) of the host and path rules, which stand above the list.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
GENERATED = 1_000_000  # made-up pages in the list of op7, beside those of its table
WORDS = 8  # 64-bit words of a block; each key sets one bit in every word
MAX_BLOCKS = 1 << 18  # 16 MB: the size that is broadcast never passes this, however long the list


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as the contract of op7 states them; both empty for null and where "://" is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _decoded(path: Column) -> Column:
    """The path with percent codes of letters, digits and - . _ ~ decoded, and those of all else in capitals; what is no code stays."""
    code = lambda p: F.conv(F.left(p, F.lit(2)), 16, 10).cast("int")
    rest = lambda p: F.substr(p, F.lit(3))

    def piece(p: Column, i: Column) -> Column:
        valid = p.rlike("^[0-9A-Fa-f]{2}")
        plain = valid & (code(p) < 128) & F.char(code(p)).rlike("^[A-Za-z0-9._~-]$")
        return F.when(i == 0, p).when(plain, F.concat(F.char(code(p)), rest(p))).when(valid, F.concat(F.lit("%"), F.upper(F.left(p, F.lit(2))), rest(p))).otherwise(F.concat(F.lit("%"), p))

    return F.when(F.instr(path, "%") > 0, F.array_join(F.transform(F.split(path, "%"), piece), "")).otherwise(path)


def plain_host(host: Column) -> Column:
    """A host without user part, port 80 or 443, closing dots, "www." or "m."."""
    host = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":(80|443)?$", "")
    return F.regexp_replace(F.regexp_replace(host, r"\.+(:|$)", "$1"), r"^(www|m)\.", "")


def canonical(host: Column, path: Column) -> Column:
    """Canonical URL of a page: its plain host, and its path with letters, digits and - . _ ~ decoded, without a closing "/" or "index.html"."""
    return F.concat(plain_host(host), F.regexp_replace(_decoded(path), r"/(index\.html)?$", ""))


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(17))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bloom_filter(keys: DataFrame, expected: int, bits_per_key: int = 16) -> tuple[DataFrame, int]:
    """(one row per block in use, number of blocks) of the strings in column `key`."""
    blocks = min(MAX_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, expected) * bits_per_key / (64 * WORDS)))))
    words = [F.bit_or(b).alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))]
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*words), blocks


def maybe_listed(probes: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows whose `key` may be in the filter: no false negatives, some false positives."""
    joined = probes.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(bloom), "block")
    hit = F.lit(True)
    for i, b in enumerate(_bits(F.col("key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(b) != 0)
    return joined.where(hit).select(*probes.columns)


def with_possibly(probes: DataFrame, bloom: DataFrame, blocks: int, out: str) -> DataFrame:
    """All rows, and in column `out` whether their `key` may be in the filter."""
    hit = F.lit(True)
    for i, b in enumerate(_bits(F.col("key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(b) != 0)
    joined = probes.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(bloom), "block", "left")
    return joined.select(*probes.columns, F.coalesce(hit, F.lit(False)).alias(out))


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """pages plus host, path, rule and verdict.

    rules(verdict, rule): rule is host and path prefix; it fits the host and its subdomains, the longest
    one wins. listed(key): canonical URLs, or "host/" for whole sites, which also hold for their plain hosts. Where no rule fits, the verdict is
    "block" for listed pages, else "allow". Rules and list share one Bloom filter; what passes it is
    joined exactly, so its false positives never show. A null or malformed url has empty host and path,
    fits nothing and is allowed. No url is too frequent: common ones and nulls are not dealt by url. Repeated rows
    get equal results; an empty list or rule set is allowed;
    columns of `pages` named host, path, rule or verdict are replaced.
    """
    rules = rules.where("rule is not null").select(F.col("rule").alias("key"), F.col("verdict").alias("says"), F.lit("rule").alias("kind"))
    entries = rules.unionByName(listed.where("key is not null").select("key", F.lit("block").alias("says"), F.lit("list").alias("kind"))).distinct()
    facts = entries.agg(F.count("*"), F.collect_set(F.when(F.col("kind") == "rule", F.length(F.regexp_extract("key", r"^[^/]*(.*)$", 1))))).first()
    lengths = sorted(facts[1])  # distinct lengths of rule paths: no more than a URL has characters
    bloom, blocks = bloom_filter(entries.select("key").distinct(), facts[0])

    host, path = url_parts(F.col("url"))
    urls = pages.where("url is not null").groupBy("url").agg(F.count("*").alias("n")).select("url", "n", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.left("path", F.lit(n)) for n in lengths if n > 0], *([F.lit("")] if 0 in lengths else []))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    bare = F.split(plain_host(F.col("host")), r"\.")
    sites = F.array_union(F.transform(suffixes, lambda s: F.concat(s, F.lit("/"))), F.transform(F.sequence(F.lit(1), F.size(bare)), lambda i: F.concat(F.array_join(F.slice(bare, i, F.size(bare)), "."), F.lit("/"))))
    kinds = lambda ks, kind: F.transform(F.array_distinct(ks), lambda k: F.struct(k.alias("key"), F.lit(kind).alias("kind")))
    probes = urls.where("host <> ''").select("url", F.inline(F.concat(kinds(keys, "rule"), kinds(F.array_append(sites, canonical(F.col("host"), F.col("path"))), "list"))))
    hits = maybe_listed(probes, bloom, blocks).join(entries, ["key", "kind"])
    best = F.max(F.when(F.col("kind") == "rule", F.struct(F.length("key").alias("n"), F.col("key").alias("rule"), F.col("says"))))
    found = hits.groupBy("url").agg(best.alias("best"), F.bool_or(F.col("kind") == "list").alias("on_list"))
    kept = pages.select(*[c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")])
    verdict = F.coalesce("best.says", F.when(F.col("on_list"), "block"), F.lit("allow"))
    facts = urls.join(found, "url", "left").select("url", F.col("n").alias("__n"), F.col("best.rule").alias("rule"), verdict.alias("verdict"))
    out = join_facts(kept.where("url is not null"), facts, ["url"], "__n", pages.count())
    out = out.unionByName(kept.where("url is null").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")}), allowMissingColumns=True)
    host, path = url_parts(F.col("url"))
    return out.select(*kept.columns, host.alias("host"), path.alias("path"), "rule", "verdict")


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*RULES], "verdict string, rule string")


def default_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in BLOCKED], "key string")


def large_list(pages: DataFrame, generated: int = GENERATED) -> DataFrame:
    """(key): the default list, the canonical urls of an eighth of the pages(url), by the first digit of their MD5, and so many pages of made-up sites."""
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    key = canonical(host, path)
    seen = pages.where(host != "").select(key.alias("key")).where(F.md5("key") < "2").distinct()
    made = spark.range(generated).select(F.concat(F.lit("site"), (F.col("id") % 50_000).cast("string"), F.lit(".example.net/page/"), F.col("id").cast("string")).alias("key"))
    return default_list(spark).unionByName(seen).unionByName(made)


def filter_hits(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """One row (probes, passed, listed): distinct canonical urls of the pages, how many pass the filter of the list, and how many of these the list really has."""
    host, path = url_parts(F.col("url"))
    keys = pages.where(host != "").select(canonical(host, path).alias("key")).distinct()
    entries = listed.where("key is not null").select("key").distinct()
    bloom, blocks = bloom_filter(entries, entries.count())
    passed = maybe_listed(keys, bloom, blocks)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(keys, "probes").join(count(passed, "passed")).join(count(passed.join(entries, "key", "left_semi"), "listed"))  # one row each


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, default_rules(spark), large_list(pages)).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{v}', '{r}')" for v, r in RULES)
_LISTED = ", ".join(f"('{k}')" for k in BLOCKED)
SQL = rf"""
WITH rules(says, rule) AS (VALUES {_VALUES}), listed(key) AS (VALUES {_LISTED}),
u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
d AS (SELECT DISTINCT host, path FROM p),
fit AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says
        FROM d JOIN rules ON ('.' || host) LIKE ('%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, instr(rule, '/')))
        WHERE host <> '' GROUP BY ALL),
pl AS (SELECT host, path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', ''), '\.+(:|$)', '\1'), '^(www|m)\.', '') AS h,
  regexp_replace(array_to_string(list_transform(string_split(path, '%'), lambda x, i: CASE WHEN i = 1 THEN x WHEN regexp_matches(x, '^[0-9A-Fa-f]{{2}}') THEN
    CASE WHEN TRY_CAST('0x' || left(x, 2) AS INT) < 128 AND regexp_matches(chr(greatest(TRY_CAST('0x' || left(x, 2) AS INT), 1)), '^[A-Za-z0-9._~-]$') THEN chr(greatest(TRY_CAST('0x' || left(x, 2) AS INT), 1)) || substr(x, 3) ELSE '%' || upper(left(x, 2)) || substr(x, 3) END ELSE '%' || x END), ''), '/(index\.html)?$', '') AS q FROM d),
keys AS (SELECT key FROM listed UNION ALL SELECT DISTINCT h || q FROM pl WHERE host <> '' AND md5(h || q) < '2' UNION ALL SELECT 'site' || (i % 50000)::VARCHAR || '.example.net/page/' || i::VARCHAR FROM range({GENERATED}) AS r(i)),
bad AS (SELECT DISTINCT host, path FROM (SELECT host, path FROM pl JOIN keys ON host <> '' AND key = h || q
  UNION ALL SELECT host, path FROM pl JOIN listed ON host <> '' AND key LIKE '%/' AND (('.' || host || '/') LIKE ('%.' || key) OR ('.' || h || '/') LIKE ('%.' || key))))
SELECT page_id, p.host, p.path, fit.rule AS rule,
       coalesce(fit.says, CASE WHEN bad.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN fit ON p.host = fit.host AND p.path = fit.path
       LEFT JOIN bad ON p.host = bad.host AND p.path = bad.path
"""
