"""Mixing sources to target weights by capped water-filling.

Each source weighs 5, 2, 1, 5, 2, 1, ... in code point order, null last, and the sources share the sum of all sizes. A
source may be used at most `max_epochs` times over; what a clamped source leaves is shared by weight among the rest until
none is above. Filling has a closed form: in order of cap / weight, the level after clamping the first i sources is
(total - their caps) / (the weights left), and the final level is the largest of these.

Repetitions: target = k whole passes + a rest. Every document is taken k times; the rest is one more pass over the
documents in a seeded order, up to the document whose middle passes the mark. The order is an md5 of seed and id, so
reruns agree, and the taken words of a source differ from its target by at most half a document. Running sums are taken
in two steps (sums of hash buckets, then inside a bucket), so a source that holds a third of all rows is never in one
task.

Null or wordless texts have size 0 and are taken 0 words; a null source is a source of its own; repeated rows count each;
an empty table gives no rows; columns beside doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm.common import n_words, table
from lurewatch.session import cut_lineage

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, "mix-1"
BUCKET_CHARS = 3  # 4,096 buckets a source


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, so one small window."""
    w = F.array(*[F.lit(x) for x in weights])
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    df = sizes.withColumn("weight", F.element_at(w, F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1))
    df = df.withColumn("cap", F.col("source_size") * max_epochs)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / left
    df = df.withColumn("level", level)
    level = F.max("level").over(whole)
    return df.select("source", "source_size", F.least(F.col("weight") * level, F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, epochs): taken = size * epochs, all documents."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = cut_lineage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key")).withColumn(
        "bucket", F.substring("key", 1, BUCKET_CHARS)).withColumn("skey", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    per = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    target = source_targets(per.groupBy("skey").agg(F.sum("words").alias("source_size"), F.first("source").alias("source")).drop("skey"), weights, max_epochs)
    target = target.withColumn("skey", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("skey", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base")).join(target, "skey")
    inside = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["skey", "bucket"])
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    df = df.withColumn("passes", passes)
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    more = (2 * (F.col("base") + F.col("within")) + F.col("size") <= 2 * rest) & (F.col("size") > 0) & (F.col("passes") < max_epochs)
    df = df.withColumn("epochs", F.col("passes") + more.cast("long"))
    return df.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"), "epochs")


def op2(spark, d: str) -> DataFrame:
    return mix(table(d, "documents", spark)).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighted AS (
  SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight FROM src),
filled AS (
  SELECT *, source_size * 3 AS cap,
         ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(source_size * 3) OVER before, 0)::DOUBLE)
           / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighted
  WINDOW before AS (ORDER BY source_size * 3 / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
target AS (SELECT source, source_size, least(weight * max(level) OVER (), cap::DOUBLE) AS target FROM filled),
placed AS (
  SELECT r.*, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS passes
  FROM rows r JOIN target t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (passes + CASE WHEN 2 * before + size <= 2 * (target - passes * source_size) AND size > 0 AND passes < 3 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
