"""Helpers that keep hot keys from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def salted_lookup(big: DataFrame, small: DataFrame, key: str | list[str], how: str = "left", salts: int | None = None) -> DataFrame:
    """Join a large frame to a lookup that holds at most one row per key, without a hot task.

    Catalyst picks the strategy (it broadcasts by measured size and AQE splits skewed partitions). With `salts`, the
    caller asks for explicit salting: the lookup side is repeated per salt and the large side gets a random-free salt
    from its row hash, so a key with a third of all rows spreads over `salts` tasks.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if not salts:
        return big.join(small, keys, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    fanned = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(fanned, [*keys, "_salt"], how).drop("_salt")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by `order`, as an aggregate: copies collapse on the map side, so a key holding a third
    of the rows costs one partial row per map task (a row_number window would pull the whole key into one task)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, spread: Column, parts: int = 64) -> DataFrame:
    """Top n rows of each group in two steps: first inside `parts` slices of the group, then over the n x parts
    survivors. Exact, and no task ever sorts a whole hot group."""
    df = df.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(parts)))
    local = Window.partitionBy(*group, "_part").orderBy(*order)
    kept = df.withColumn("_rn", F.row_number().over(local)).where(F.col("_rn") <= n).drop("_rn", "_part")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def in_ranges(df: DataFrame, order: list[str], name: str = "_b") -> DataFrame:
    """Add the number of the range a row falls in, as a written table. Ranges are cut at sampled quantiles of the order, so each holds about
    as many rows wherever values pile up; rows of equal order share one, and the number grows with the order."""
    from lurewatch.session import cut_lineage
    return cut_lineage(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


def prefix_before(df: DataFrame, keys: list[str], order: Column, bucket: Column | None, aggs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running aggregates over the rows of the same key with a strictly smaller `order`.

    `aggs` maps an output name to ("sum" | "min" | "max" | "bit_or", value). Rows are first reduced per (key, bucket); a window over
    those few rows gives what lies in earlier buckets, and a window inside one bucket gives the rest. No window ever spans a
    whole key. `bucket` must grow with `order` (a day, an hour); without one, rows are cut into ranges of equal size.
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max, "bit_or": F.bit_or}

    def both(how, a, b):
        if how == "sum":
            return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        if how == "bit_or":
            return F.coalesce(a, F.lit(0)).bitwiseOR(F.coalesce(b, F.lit(0)))
        return (F.least if how == "min" else F.greatest)(a, b)

    df = df.withColumns({"_o": order, **{f"_v_{n}": v for n, (_, v) in aggs.items()}})
    df = df.withColumn("_b", bucket) if bucket is not None else in_ranges(df, [*keys, "_o"])
    per = df.groupBy(*keys, "_b").agg(*[fold[h](f"_v_{n}").alias(f"_p_{n}") for n, (h, _) in aggs.items()])
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_b", *[fold[h](f"_p_{n}").over(earlier).alias(f"_e_{n}") for n, (h, _) in aggs.items()])
    # inside a bucket: everything up to the previous distinct order value
    inside = Window.partitionBy(*keys, "_b").orderBy("_o")
    upto = inside.rangeBetween(Window.unboundedPreceding, -1)
    df = df.select("*", *[fold[h](f"_v_{n}").over(upto).alias(f"_i_{n}") for n, (h, _) in aggs.items()])
    out = df.join(per, [*keys, "_b"], "left") if keys else df.join(per, "_b", "left")
    out = out.withColumns({n: both(h, F.col(f"_e_{n}"), F.col(f"_i_{n}")) for n, (h, _) in aggs.items()})
    return out.drop("_o", "_b", *[f"_{k}_{n}" for n in aggs for k in ("v", "e", "i")])


def dense_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the 0-based place of each row in the order, without one sorted task: sampled ranges are sorted by themselves, and each
    gets the number of rows in the ranges before it (a row per range)."""
    from lurewatch.session import cut_lineage
    at, mask = "_at", (1 << 33) - 1
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)
    per = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = per.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col(at).bitwiseAND(F.lit(mask))).drop(at, "_part", "_before")
