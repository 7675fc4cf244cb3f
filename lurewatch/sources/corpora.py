"""Corpus readers and writers: CSV corpora, normalisation, unions, caches, lists and review exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.functions.common import collapse
from lurewatch.functions.threads import content_key
from lurewatch.rules import patterns as P

CANON = ("source", "sender", "receiver", "date", "subject", "body", "label")
HEADERS = ("reply_to", "return_path", "auth_results", "attachments")
INLINE_SUBJECT = r"(?s)^\s*Subject:\s*(.*?)(?:\r?\n|\s{2,})(.*)$"

# The named entities scraped HTML uses most.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def html_text(html: Column) -> Column:
    """Entities decoded, tags dropped, whitespace collapsed."""
    out = html
    for k, v in ENTITIES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.trim(F.regexp_replace(F.regexp_replace(out, P.HTML_TAG, " "), "[\\s ]+", " "))


def read_corpus_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A corpus CSV whose quoted fields hold newlines. Malformed lines are skipped; every field is read as text."""
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    return (spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"')
            .option("escape", '"').option("mode", "DROPMALFORMED").option("enforceSchema", False).csv(path))


def normalise(df: DataFrame, source: str, inline_subject: bool = False) -> DataFrame:
    """Canonical rows: text columns filled, label kept only when 0 or 1, blank bodies dropped.

    With `inline_subject` the body starts with "Subject: ..." and is split at the first newline or run of spaces.
    """
    if inline_subject:
        body = F.col("body")
        df = df.withColumn("_whole", body).withColumns({
            "subject": F.regexp_extract("_whole", INLINE_SUBJECT, 1),
            "body": F.when(F.col("_whole").rlike(INLINE_SUBJECT), F.regexp_extract("_whole", INLINE_SUBJECT, 2)).otherwise(body),
        }).drop("_whole")
    for c in (*CANON[1:6], *HEADERS):
        df = df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit(""))
    num = F.col("label").try_cast("double")
    df = df.withColumn("label", num.cast("int")).where(num.isin(0.0, 1.0) & F.col("body").rlike(r"\S"))
    keep = ["message_id"] if "message_id" in df.columns else []
    return df.withColumn("source", F.lit(source)).select(*keep, *CANON, *HEADERS)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All sources in one frame, matched by column name, absent columns NULL then filled with ''."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in out.dtypes])


def with_content_key(df: DataFrame) -> DataFrame:
    return df.withColumn("content_key", content_key(F.col("subject"), F.col("body")))


def write_cache(df: DataFrame, path: str) -> None:
    """One keyed table of features, metadata and text, split by partition. Bodies live in `text` only."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def domain_list(df: DataFrame, column: str = "value") -> DataFrame:
    """Distinct lower-cased domains of a newline list; `#` starts a comment."""
    d = F.lower(F.trim(F.split_part(F.col(column), F.lit("#"), F.lit(1))))
    return df.select(d.alias("domain")).where("domain <> ''").distinct()


def read_domain_list(spark: SparkSession, path: str) -> DataFrame:
    return domain_list(spark.read.text(path))


def read_psv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A pipe-separated numeric table: bad lines skipped, anything that is not a number becomes NULL."""
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    df = (spark.read.schema(schema).option("header", True).option("sep", "|").option("mode", "DROPMALFORMED")
          .option("enforceSchema", False).csv(path))
    return df.select(*[F.col(c).try_cast("double").alias(c) for c in columns])


def preview(text: Column, n: int = 500) -> Column:
    return F.left(collapse(text), F.lit(n))


def review_rows(df: DataFrame, answers: tuple[str, ...] = ("true_vector",)) -> DataFrame:
    """Rows for a human: a short preview and blank answer columns."""
    return df.withColumn("text_preview", preview(F.col("body"))).drop("body").withColumns({a: F.lit("") for a in answers})


_REVIEW = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_review(df: DataFrame, path: str) -> None:
    """Review rows as CSV, white space kept."""
    df.write.mode("overwrite").options(**_REVIEW).csv(path)


def read_review(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The sheet as filled in; an empty answer is an empty text."""
    df = spark.read.schema(", ".join(f"`{c}` STRING" for c in columns)).options(**_REVIEW, multiLine=True).csv(path)
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])
