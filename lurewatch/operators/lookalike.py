"""Nearest well-known domain as a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.sender import LOOKALIKE_TARGETS
from lurewatch.rules import dims


def near_domains(df: DataFrame) -> DataFrame:
    """(registrable, lookalike_of, distance). Works on distinct domains; the fixed target list is fanned out to the five
    lengths it may pair with, so the length bound is an equi join and edit distance runs inside a length bucket only."""
    spark = df.sparkSession
    targets = spark.createDataFrame([(t, len(t) + k) for t in LOOKALIKE_TARGETS for k in (-2, -1, 0, 1, 2)], "target string, len int")
    seen = df.select("registrable").distinct().where(
        (F.length("registrable") >= 8) & ~F.col("registrable").isin(*dims.LEGIT_DOMAINS)).withColumn("len", F.length("registrable"))
    pairs = seen.join(F.broadcast(targets), "len").withColumn("distance", F.levenshtein("registrable", "target", 2)).where("distance > 0")
    return pairs.groupBy("registrable").agg(F.min(F.struct("distance", "target")).alias("b")).select(
        "registrable", F.col("b.target").alias("lookalike_of"), F.col("b.distance").alias("distance"))
