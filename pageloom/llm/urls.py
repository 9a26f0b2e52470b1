"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A listed rule is (host, path, verdict). It fits its host and all subdomains where the url's path starts with the
rule's; the longest fitting rule (host and path characters) wins, among equals the longer host. Each distinct url
gives its host suffixes times the path prefixes of listed lengths; those that the filter passes go to the exact join.
The filter has one 64-bit block per probe and at most ``blocks`` blocks, whatever the list's size: a longer list makes
it pass more, never drop any.

Null urls and urls without ``://`` have empty host and path; empty hosts fit no rule and get ``default``. Repeated
rows give one result row each. An empty list leaves every url to ``default``; empty pages give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.llm.common import table
from pageloom.operators.skew import spread_join

#: Fixed rules of the query: host, path, verdict.
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
BLOCKS, PROBES, SMALL = 1 << 20, 4, 100_000


def canonical(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty when there is no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(F.substr(rest, F.length(host) + 1), F.lit(""))


def _mask(host: Column, path: Column) -> Column:
    bits = F.xxhash64(F.lit(1), host, path)
    mask = F.lit(0).cast("bigint")
    for i in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def _block(host: Column, path: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), host, path), F.lit(blocks)).cast("int")


def bloom(rules: DataFrame, blocks: int = BLOCKS) -> tuple[int, list[int]]:
    """Number of blocks and their bits; about 16 bits a rule, never more than ``blocks`` blocks."""
    n = max(1, min(blocks, rules.count() // 4 + 1))
    rows = rules.groupBy(_block(F.col("host"), F.col("path"), n).alias("b")).agg(F.bit_or(_mask(F.col("host"), F.col("path"))).alias("m")).collect()
    bits = [0] * n
    for r in rows:
        bits[r.b] = r.m
    return n, bits


def judged(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``key, host, path, rule, verdict`` of every row of ``pages``."""
    spark = pages.sparkSession
    host, path = canonical(F.col(url))
    rows = pages.select(key, host.alias("host"), path.alias("path"))
    n, bits = bloom(rules)
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().limit(10_001).collect())
    filter_ = F.broadcast(spark.createDataFrame([(bits,)], "bits array<bigint>"))
    seen = rows.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if len(lengths) > 10_000:  # then every prefix of the path is tried
        sizes = F.sequence(F.lit(0), F.length("path"))
    else:
        sizes = F.filter(F.array(*[F.lit(i) for i in lengths]).cast("array<int>"), lambda i: i <= F.length("path"))
    tried = seen.select("host", "path", F.explode(suffixes).alias("rule_host"), sizes.alias("sizes")).select(
        "host", "path", "rule_host", F.explode("sizes").alias("size")).withColumn("rule_path", F.substr("path", F.lit(1), F.col("size")))
    mask = _mask(F.col("rule_host"), F.col("rule_path"))
    block = _block(F.col("rule_host"), F.col("rule_path"), n)
    hits = tried.join(filter_).where(F.get("bits", block).bitwiseAND(mask) == mask).drop("bits", "size")
    listed = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict"))
    listed = listed.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    on = ["rule_host", "rule_path"]
    exact = hits.join(F.broadcast(listed), on) if rules.count() <= SMALL else spread_join(hits, listed, on, ["host", "path"], "inner", rows=5_000)
    size = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))
    best = exact.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), size).alias("r"))
    found = spread_join(rows, best, ["host", "path"], [key], rows=5_000)
    return found.select(key, "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict"))


def op2_urls(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP2_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(substr(rest, length(regexp_extract(rest, '^([^/]*)', 1)) + 1), '') AS path FROM u),
l(h, f, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path,
  (SELECT arg_max(h || f, length(h || f)) FROM l WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f)) AS rule,
  coalesce((SELECT arg_max(v, length(h || f)) FROM l WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f)), 'allow') AS verdict
FROM p
"""
