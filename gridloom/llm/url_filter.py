"""URL filters (native): a sort-merge range join of urls with host/path rules.

A host is turned into its canonical key, the labels reversed and each followed by a dot (``www.example.com`` becomes
``com.example.www.``). All hosts below a rule's host are then one interval of the key order, and the intervals of any
rule set are nested or disjoint. Urls and rule starts are sorted together by key and swept once. Every rule start carries
the stack of rules that are active there (its own and those it is nested in), so the last start at or before a url
holds all rules that can cover it; those that have ended are popped by a prefix test. The longest one whose path begins
the url's path wins.

Skew: the sweep is dealt by (top label, salt). The salt hashes the url, so that a host or a top label with a third of
all rows spreads over ``salts`` shards; each shard gets a copy of the rules of its top label. Nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii, shuffle_partitions, table

#: The rules of the query, (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def url_host(url: Column) -> Column:
    rest = F.element_at(F.split(url, "://", 2), 2)
    return F.when(
        F.contains(url, F.lit("://")), lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    ).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.element_at(F.split(url, "://", 2), 2)
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """One row per rule host: key and the stack of rules active there.

    Nodes that share a top label are few against urls; a node finds those it is nested in through its own key prefixes.
    """
    keyed = rules.where(F.col("host").isNotNull()).select(
        host_key(lower_ascii(F.col("host"))).alias("node"),
        F.struct(
            F.length(F.concat("host", F.coalesce("path", F.lit("")))).alias("len"),
            F.length("host").alias("host_len"),
            F.concat("host", F.coalesce("path", F.lit(""))).alias("rule"),
            host_key(lower_ascii(F.col("host"))).alias("node"),
            F.coalesce("path", F.lit("")).alias("path"),
            F.col("verdict").alias("verdict"),
        ).alias("r"),
    )
    nodes = keyed.groupBy("node").agg(F.collect_set("r").alias("own"))
    labels = F.split(F.col("node"), r"\.")
    ups = nodes.select(
        F.col("node").alias("key"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(labels) - 1),
                lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")),
            )
        ).alias("node"),
    )
    return ups.join(nodes, "node").groupBy("key").agg(F.flatten(F.collect_list("own")).alias("stack"))


def filter_urls(
    urls: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", salts: int | None = None
) -> DataFrame:
    """All rows and columns of ``urls`` in a struct ``row``, with host, path, rule and verdict.

    ``rules``: host, path, verdict. Null urls and urls without ``://`` have an empty host and path. Of rules of the same
    length the one with the longer host wins, then the greater rule text, then the greater verdict (``block``). Repeated
    urls keep a row each; no rules or no urls are fine; columns of ``urls`` may have any names.
    """
    salts = salts or max(64, 4 * shuffle_partitions(urls.sparkSession))
    own = F.col(f"`{url}`")
    left = urls.select(F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("row"), own.alias("u"))
    left = left.select(
        "row",
        url_host(F.col("u")).alias("host"),
        url_path(F.col("u")).alias("path"),
        F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"),
    )
    left = left.withColumn("key", host_key(F.col("host"))).withColumn("top", F.substring_index("key", ".", 1))
    starts = rule_stacks(rules).select(
        F.substring_index("key", ".", 1).alias("top"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        "key",
        F.lit(0).alias("kind"),
        "stack",
    )
    events = left.withColumn("kind", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    sweep = Window.partitionBy("top", "salt").orderBy("key", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    swept = events.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = F.filter("active", lambda r: F.startswith(F.col("key"), r["node"]) & F.startswith(F.col("path"), r["path"]))
    return swept.withColumn("best", F.array_max(fits)).select(
        "row",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rule_table(spark)).select("row.page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), r(rh, rp, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)
"""
