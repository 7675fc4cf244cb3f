"""Deterministic sampling: a hash of the group key decides, so any cluster and any retry draw the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.operators.skew import top_per_group


def hash_bucket(key: Column, salt: str = "") -> Column:
    """0..99 from the md5 of key and salt."""
    return F.pmod(F.conv(F.left(F.md5(F.concat(key.cast("string"), F.lit(salt))), F.lit(8)), 16, 10).cast("bigint"), F.lit(100))


def group_split(df: DataFrame, key: Column, test_pct: int = 20) -> DataFrame:
    """Add split: all rows of one group fall on the same side."""
    return df.withColumn("split", F.when(hash_bucket(key) < test_pct, F.lit("test")).otherwise(F.lit("train")))


def calibration_slice(df: DataFrame, key: Column, pct: int = 15) -> DataFrame:
    """Move a slice of train to calib, with a second salt."""
    return df.withColumn("split", F.when((F.col("split") == "train") & (hash_bucket(key, "calib") < pct), F.lit("calib")).otherwise(F.col("split")))


def order_hash(key: Column, salt: str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(salt)))


def quota(df: DataFrame, group: list[str], key: str, salt: str, limits: dict[str, int], by: str) -> DataFrame:
    """The first rows of each group in hash order, up to the group's own limit."""
    most = max(limits.values())
    out = top_per_group(df.withColumn("_h", order_hash(F.col(key), salt)), group, [F.col("_h"), F.col(key)], most, F.col(key))
    limit = F.lit(0)
    for name, n in limits.items():
        limit = F.when(F.col(by) == name, F.lit(n)).otherwise(limit)
    return out.where(F.col("rank") <= limit).drop("_h")
