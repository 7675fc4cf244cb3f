"""URL filters as a sort-merge range join, in DataFrame operations only.

A host becomes a canonical key of reversed labels ("www.example.com" -> "com.example.www."). A rule covers its host and
all subdomains, so it is the interval of all keys that begin with its own key. Intervals of one depth (number of labels)
are disjoint and those of different depths nest, so a sweep over the sorted keys needs one stack slot per depth: the last
rule of that depth that was passed, active while the key still begins with the rule's key. The sweep is one window with
`last(... ignore nulls)` per depth.

Distinct hosts are swept, never pages, so a hot host is one row. The key space is cut at splitters drawn from the hosts
(a bounded sample, by hash); a rule is placed in every slice its interval meets, so each slice starts with its own stack.
Path prefixes and "the longest rule wins" are then decided per page over the rules of its active stack.

Null urls and urls without "://" have an empty host and path and get the default verdict. Equal rules: block wins. The
rules of one host travel as one array. Empty tables give no rows; other columns of the pages are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm.common import table
from lurewatch.session import cut_lineage

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
SLICES, OVERSAMPLE = 64, 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rules_frame(spark, rules=RULES) -> DataFrame:
    """(host, path, verdict) from texts like example.com/en/."""
    return spark.createDataFrame([(r[: r.index("/")], r[r.index("/"):], v) for r, v in rules], "host string, path string, verdict string")


def _slice_of(key: Column, splits: list[str]) -> Column:
    if not splits:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(s) for s in splits]), lambda s: s <= key))


def host_stacks(hosts: DataFrame, rules: DataFrame, slices: int = SLICES) -> DataFrame:
    """(host, stack): the rules (host, path, verdict) whose host is the host or a parent of it. Hosts without are left out."""
    groups = rules.groupBy("host").agg(F.collect_list(F.struct("host", "path", "verdict")).alias("rules")).select(
        canonical(F.col("host")).alias("key"), "rules", F.size(F.split("host", r"\.")).alias("depth"))
    depths = sorted(r[0] for r in groups.select("depth").distinct().collect())  # labels in a host name, a small number
    keyed = hosts.select("host", canonical(F.col("host")).alias("key"))
    drawn = keyed.orderBy(F.xxhash64("key"), "key").limit(slices * OVERSAMPLE)  # a top-k, bounded by the parameter
    splits = sorted({r[0] for r in drawn.select("key").collect()})[OVERSAMPLE::OVERSAMPLE]
    first, last = _slice_of(F.col("key"), splits), _slice_of(F.concat(F.expr("substr(key, 1, length(key) - 1)"), F.lit("/")), splits)
    starts = groups.withColumn("slice", F.explode(F.sequence(first, last)))
    passing = F.struct("key", "rules")
    empty = F.lit(None).cast(starts.select(passing.alias("r")).schema["r"].dataType)
    opened = starts.select("slice", "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "depth", passing.alias("r"))
    asked = keyed.select(_slice_of(F.col("key"), splits).alias("slice"), "key", F.lit(1).alias("kind"), "host", F.lit(0).alias("depth"), empty.alias("r"))
    sweep = Window.partitionBy("slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = opened.unionByName(asked)
    df = df.select("kind", "key", "host", *[F.last(F.when((F.col("kind") == 0) & (F.col("depth") == n), F.col("r")), ignorenulls=True).over(sweep).alias(f"slot{n}") for n in depths])
    none = F.array().cast("array<struct<host:string,path:string,verdict:string>>")
    slots = [F.when(F.startswith(F.col("key"), F.col(f"slot{n}.key")), F.col(f"slot{n}.rules")).otherwise(none) for n in depths]
    stack = F.concat(*slots) if slots else none
    return df.where("kind = 1").select("host", stack.alias("stack")).where(F.size("stack") > 0)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page."""
    host, path = host_and_path(F.col("url"))
    df = cut_lineage(pages.select("page_id", host.alias("host"), path.alias("path")))
    stacks = host_stacks(df.select("host").distinct(), rules)
    fits = F.filter("stack", lambda r: F.startswith(F.col("path"), r.path))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r.host) + F.length(r.path), r.verdict.alias("verdict"), F.concat(r.host, r.path).alias("rule"))))
    df = df.join(stacks, "host", "left").withColumn("best", best)
    return df.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op4(spark, d: str) -> DataFrame:
    return filter_urls(table(d, "pages", spark), rules_frame(spark))


OP4_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                      ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
numbered AS (SELECT *, row_number() OVER () AS n FROM parts),
best AS (
  SELECT n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM numbered p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY n)
SELECT page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM numbered p LEFT JOIN best b USING (n)
"""
