"""What a mailbox is exposed to, read off its own mail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.common import string_map
from lurewatch.operators.skew import salted_lookup
from lurewatch.rules import patterns as P, taxonomy as X

AREAS = tuple(P.EXPOSURE)


def profiles(messages: DataFrame, key: str = "mailbox") -> DataFrame:
    """messages and hit counts per area for each recipient; only flags are shuffled."""
    text = F.left(F.concat("subject", F.lit(" "), "body"), F.lit(6000))
    flags = messages.select(key, text.alias("t")).select(key, *[F.col("t").rlike(p).alias(a) for a, p in P.EXPOSURE.items()])
    out = flags.groupBy(key).agg(F.count("*").alias("messages"), *[F.count_if(a).alias(a) for a in AREAS])
    return out.withColumns({f"{a}_rate": F.least(F.lit(1.0), F.col(a) / F.greatest(F.col("messages") * 0.15, F.lit(1.0))) for a in AREAS})


def with_multiplier(df: DataFrame, recipients: DataFrame, key: str = "mailbox", vector: str = "vector") -> DataFrame:
    """Add r_mult: 1 + w for a heavily exposed recipient, 1 - 0.4 w for a barely exposed one, needs 50 messages."""
    rates = recipients.select(key, F.col("messages").alias("r_messages"), F.map_from_arrays(
        F.array(*[F.lit(a) for a in AREAS]), F.array(*[F.col(f"{a}_rate") for a in AREAS])).alias("r_rates"))
    area = F.element_at(string_map((v, a) for v, (a, _) in X.VECTOR_EXPOSURE.items()), F.col(vector))
    weight = F.expr("map(" + ", ".join(f"'{v}', {w}D" for v, (_, w) in X.VECTOR_EXPOSURE.items()) + ")")
    df = salted_lookup(df, rates, key).withColumns({"r_area": area, "r_weight": F.element_at(weight, F.col(vector))})
    rate = F.element_at("r_rates", F.col("r_area"))
    mult = (
        F.when((F.col("r_messages") < 50) | F.col("r_messages").isNull() | F.col("r_area").isNull(), F.lit(1.0))
        .when(rate >= 0.5, 1.0 + F.col("r_weight"))
        .when(rate <= 0.05, 1.0 - F.col("r_weight") * 0.4)
        .otherwise(F.lit(1.0)))
    return df.withColumn("r_mult", mult).drop("r_rates")
