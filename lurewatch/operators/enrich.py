"""Joins to supplied reference tables: domain age, file reputation, breach exposure. Unknown stays unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.body import extension
from lurewatch.functions.common import flag, string_map
from lurewatch.rules import dims, patterns as P
from lurewatch.operators.skew import salted_lookup


def domain_age(df: DataFrame, registry: DataFrame, as_of: Column) -> DataFrame:
    """Add domain_age_days as of a date, from the registration date (never from a stored age)."""
    reg = registry.select(F.col("domain").alias("registrable"), "registered")
    out = salted_lookup(df, reg, "registrable")
    return out.withColumn("domain_age_days", F.when(F.col("registered").isNotNull(), F.greatest(F.lit(0), F.datediff(as_of, "registered")))).drop("registered")


def age_buckets(df: DataFrame, registry: DataFrame, as_of: Column) -> DataFrame:
    df = domain_age(df, registry, as_of)
    age = F.col("domain_age_days")
    return df.withColumns({
        "dom_age_known": flag(age.isNotNull()),
        "dom_age_days": F.when(age.isNotNull(), F.least(age, F.lit(10000))).otherwise(F.lit(0)).cast("double"),
        "dom_age_under_30d": flag(age < 30),
        "dom_age_under_180d": flag(age < 180),
    })


def file_types(df: DataFrame, name: Column, head_hex: Column) -> DataFrame:
    """Add real_type, executable and type_mismatch from the first bytes of a file (upper-case hex)."""
    kind = F.lit(None).cast("string")
    runs = F.lit(False)
    for magic, label, is_exec in reversed(dims.MAGIC_BYTES):
        hit = head_hex.startswith(magic)
        kind = F.when(hit, F.lit(label)).otherwise(kind)
        runs = F.when(hit, F.lit(is_exec)).otherwise(runs)
    df = df.withColumns({"declared_ext": extension(name), "real_type": F.coalesce(kind, F.lit("unknown")), "executable": runs})
    expected = F.element_at(string_map(dims.EXPECTED_TYPE.items()), F.col("declared_ext"))
    return df.withColumn("type_mismatch", F.coalesce(
        (F.col("real_type") != "unknown") & (F.col("real_type") != expected), F.lit(False)))


def read_file_heads(spark, path: str) -> DataFrame:
    """Landed attachment files: name, size, sha256 and first bytes."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"),
                     F.sha2("content", 256).alias("sha256"), F.hex(F.substring("content", 1, 4)).alias("head_hex"))


def hash_reputation(files: DataFrame, reputation: DataFrame) -> DataFrame:
    """Left join on digest; the ratio is NULL where the digest was never seen."""
    out = salted_lookup(files, reputation, "digest")
    return out.withColumns({
        "known": F.col("total").isNotNull(),
        "detection_ratio": F.when(F.col("total") > 0, F.col("bad") / F.col("total")),
    })


def quoted_secret_exposure(df: DataFrame, body: str, leaked: DataFrame) -> DataFrame:
    """k-anonymous check: equi join on the five-character sha1 prefix, then compare the suffix.

    `leaked` holds (prefix, suffix, n). Rows without a quoted secret are kept with exposed = false.
    """
    df = df.withColumn("secret", F.regexp_extract(body, P.QUOTED_SECRET, 1))
    digest = F.upper(F.sha1("secret"))
    asked = df.where("secret <> ''").select("message_id", F.left(digest, F.lit(5)).alias("prefix"), F.substring(digest, 6, 40).alias("want"))
    hits = asked.join(leaked, "prefix").where("suffix = want").select("message_id", F.col("n").alias("exposed_count")).distinct()
    return df.join(hits, "message_id", "left").withColumns({
        "secret_quoted": F.col("secret") != "", "exposed": F.col("exposed_count").isNotNull()}).drop("secret")
