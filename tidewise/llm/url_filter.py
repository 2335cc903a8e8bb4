"""URL rules by host suffix and path prefix, as DataFrame operations only.

Each URL is expanded into its host suffixes crossed with its directory prefixes, no deeper than any rule is; the
expansions meet the rules in an equi-join on the first 4 bytes of a SHA-256, the full digest and the rule's whole path
confirm a meeting, and the longest rule wins (ties: the longer host, then block before allow). Spark broadcasts the
rules only while they are under its own size limit; beyond it the join is a shuffle on the hash prefix.

Nulls: a null url, or one without "://", has an empty host and path, and no rule. A null id is kept. Repeated rows each
get a row. An empty table gives an empty result; with no rules every verdict is the default. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import lower_ascii

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(rules: DataFrame) -> DataFrame:
    """rules (verdict, host, path) with the digest of host and directory that they are looked up by."""
    folder = F.regexp_extract("path", r"(?s)^(.*/)?", 0)
    return rules.select(
        "verdict",
        lower_ascii("host").alias("host"),
        "path",
        F.size(F.split("host", r"\.")).alias("labels"),
        (F.size(F.split(folder, "/")) - 1).alias("depth"),
        F.sha2(F.concat_ws(" ", lower_ascii("host"), folder), 256).alias("digest"),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of pages: id, host, path, rule (null: none), verdict."""
    table = rule_table(rules)
    depth = table.agg(F.max("labels"), F.max("depth"), F.min("depth")).first()
    labels, most, least = (x or 0 for x in depth)
    rows = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")).withColumn("row", F.monotonically_increasing_id())
    parts = F.split("host", r"\.")
    host_size = F.size(parts)
    suffixes = F.transform(F.sequence(F.greatest(host_size - labels + 1, F.lit(1)), host_size), lambda k: F.array_join(F.slice(parts, k, host_size), "."))
    steps = F.split("path", "/", most + 2)
    depths = F.least(F.size(steps) - 1, F.lit(most))
    folders = F.when(depths >= 1, F.transform(F.sequence(F.lit(1), F.greatest(depths, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(steps, F.lit(1), k), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    if least == 0:
        folders = F.concat(F.array(F.lit("")), folders)
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(folders, lambda d: F.concat(h, F.lit(" "), d))))
    keyed = rows.select("row", "id", "host", "path", F.explode_outer(expressions).alias("expression")).withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, 8))
    look_up = table.select(F.substring("digest", 1, 8).alias("r_short"), F.col("digest").alias("r_digest"), F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict")
    fits = (F.col("short") == F.col("r_short")) & (F.col("digest") == F.col("r_digest")) & F.startswith("path", "r_path")
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("length"),
        F.length("r_host").alias("host_length"),
        (F.col("verdict") == "block").alias("blocks"),
        F.concat("r_host", "r_path").alias("rule"),
        "verdict",
    )
    best = keyed.join(look_up, fits, "left").groupBy("row", "id", "host", "path").agg(F.max(F.when(F.col("r_digest").isNotNull(), rank)).alias("best"))
    return best.select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    # an inline table, whose size Spark knows
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS rules(verdict, host, path)")
    return judge_urls(pages, rules).withColumnRenamed("id", "page_id")


SQL = {
    "op3_url_filter": r"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
     p AS (SELECT page_id, row_number() OVER () AS k, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
     m AS (SELECT p.k, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.k ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC, r.verdict DESC) AS n
           FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.k = m.k AND m.n = 1"""
}
