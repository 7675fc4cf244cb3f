"""Sender style profiles, population spread and drift, over trait arrays.

A message is one array of 125 trait values, a sender one row of arrays (how many, mean, sd per trait). Moments are added up as
vectors, on the map side first, so no long form is ever written; comparing a message with its sender is one join by sender and
array work inside the row.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.style import MIN_MESSAGES, MIN_TRAITS, SUSPICIOUS, TRAIT_NAMES, with_traits

T = len(TRAIT_NAMES)
HELD_OUT = 6  # own messages kept back, at least, to measure a profile


def trait_rows(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., v): the trait array of every message of 80 words or more."""
    return with_traits(df, text).select(*keep, F.array(*TRAIT_NAMES).alias("v"))


def _each(fn) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(T - 1)), fn)


def moments(v: Column) -> Column:
    """How many, sum and sum of squares per trait, one after another; an absent value adds nothing."""
    return F.concat(F.transform(v, lambda x: F.when(x.isNull(), 0.0).otherwise(1.0)), F.transform(v, lambda x: F.coalesce(x, F.lit(0.0))),
                    F.transform(v, lambda x: F.coalesce(x * x, F.lit(0.0))))


def added(df: DataFrame, *keys: str, m: str = "m") -> DataFrame:
    """(keys..., m): arrays of moments added up per key."""
    return df.groupBy(*keys).agg(vector_to_array(Summarizer.sum(array_to_vector(F.col(m)))).alias("m"))


def from_moments(df: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n, mean, sd) arrays; sd is the sample sd, absent below two values."""
    n = F.transform(F.slice("m", 1, T), lambda x: F.round(x).cast("bigint"))
    df = df.withColumn("n", n).withColumn("mean", F.zip_with(F.slice("m", T + 1, T), "n", lambda s, k: F.when(k > 0, s / k)))

    def sd(i):
        k, mean, square = F.get("n", i), F.get("mean", i), F.get("m", i + 2 * T)
        within = square - k * mean * mean
        return F.when(k > 1, F.when(within > 1e-12 * square, F.sqrt(within / (k - 1))).otherwise(0.0))
    return df.withColumn("sd", _each(sd)).select(*keys, "n", "mean", "sd")


def profile(rows: DataFrame, who: str = "address") -> DataFrame:
    return from_moments(added(rows.select(who, moments(F.col("v")).alias("m")), who), who)


def population(profiles: DataFrame, min_messages: int = MIN_MESSAGES, min_senders: int = 3) -> DataFrame:
    """One row: senders, pop_mean and pop_sd per trait over the means of ready profiles; fewer than `min_senders` leave no spread."""
    ready = profiles.select(F.zip_with("mean", "n", lambda m, k: F.when(k >= min_messages, m)).alias("v"))
    one = from_moments(added(ready.select(F.lit(1).alias("all"), moments(F.col("v")).alias("m")), "all"), "all")
    return one.select(F.col("n").alias("senders"), F.col("mean").alias("pop_mean"), F.zip_with("sd", "n", lambda s, k: F.when(k >= min_senders, s)).alias("pop_sd"))


def deviations(rows: DataFrame, profiles: DataFrame, pop: DataFrame, who: str = "address", min_messages: int = MIN_MESSAGES, learned: bool = False) -> DataFrame:
    """Add dev: an array of (trait, own_n, zm, zc) for the traits that message and sender share. With `learned` the messages are part
    of their profiles; each is taken out of its own centroid again."""
    df = rows.join(profiles.select(who, F.col("n").alias("own_n"), F.col("mean").alias("own_mean")), who).crossJoin(F.broadcast(pop))  # pop is one row

    def one(i):
        value, n, mean, at, spread = F.get("v", i), F.get("own_n", i), F.get("own_mean", i), F.get("pop_mean", i), F.get("pop_sd", i)
        if learned:
            mean, n = (n * mean - value) / (n - 1), n - 1
        sure = value.isNotNull() & (n >= min_messages) & (spread > 1e-9)
        return F.when(sure, F.struct(F.element_at(F.array(*[F.lit(t) for t in TRAIT_NAMES]), i + 1).alias("trait"), n.alias("own_n"), ((value - at) / spread).alias("zm"), ((mean - at) / spread).alias("zc")))
    return df.withColumn("dev", F.filter(_each(one), lambda x: x.isNotNull())).drop("v", "own_n", "own_mean", "senders", "pop_mean", "pop_sd")


def drift(dev: DataFrame, *keys: str, min_traits: int = MIN_TRAITS) -> DataFrame:
    """1 - cosine of message and centroid, with the suspicious flag."""
    def total(fn):
        return F.aggregate("dev", F.lit(0.0), lambda a, x: a + fn(x))
    df = dev.select(*keys, F.size("dev").cast("bigint").alias("traits"), total(lambda x: x.zm * x.zc).alias("dot"), F.sqrt(total(lambda x: x.zm * x.zm)).alias("na"),
                    F.sqrt(total(lambda x: x.zc * x.zc)).alias("nb")).where((F.col("traits") >= min_traits) & (F.col("na") > 1e-9) & (F.col("nb") > 1e-9))
    d = 1.0 - F.col("dot") / (F.col("na") * F.col("nb"))
    return df.select(*keys, "traits", d.alias("drift"), (d > SUSPICIOUS).alias("suspicious"))


def top_traits(dev: DataFrame, *keys: str, n: int = 6) -> DataFrame:
    """(keys..., rank, trait, moved): the traits that moved most. Distances that differ from the ninth decimal on are equal, the name decides."""
    moved = F.array_sort(F.transform("dev", lambda x: F.struct((-F.round(F.abs(x.zm - x.zc), 9)).alias("k"), x.trait.alias("trait"))))
    df = dev.select(*keys, F.posexplode(F.slice(moved, 1, n)).alias("pos", "t"))
    return df.select(*keys, (F.col("pos") + 1).cast("bigint").alias("rank"), "t.trait", (-F.col("t.k")).alias("moved"))


def impostor_trial(rows: DataFrame, key: str, who: str = "address", first: int = MIN_MESSAGES, held_out: int = HELD_OUT) -> DataFrame:
    """(target, genuine, key, dev): profiles from each sender's first messages, compared with the messages held out: with
    their own sender's profile, and with that of another sender, chosen by rotating the senders' order by a hash of the message."""
    from lurewatch.operators.skew import dense_index, top_per_group
    from lurewatch.session import cut_lineage
    rows = cut_lineage(rows.select(key, who, "v"))
    enough = rows.groupBy(who).count().where(F.col("count") >= first + held_out).select(who)
    base = cut_lineage(top_per_group(rows.select(key, who).join(enough, who), [who], [F.col(key)], first, F.col(key)).select(key))
    profiles = cut_lineage(profile(rows.join(base, key, "left_semi"), who))
    pop = population(profiles)
    order = cut_lineage(dense_index(profiles.select(who), [F.col(who)], "place"))
    n = order.count()
    held = rows.join(enough, who).join(base, key, "left_anti")
    own = held.withColumn("target", F.col(who)).withColumn("genuine", F.lit(True))
    shift = F.pmod(F.conv(F.left(F.md5(F.col(key).cast("string")), F.lit(8)), 16, 10).cast("bigint"), F.lit(max(n - 1, 1))) + 1
    other = held.join(order, who).withColumn("place", F.pmod(F.col("place") + shift, F.lit(max(n, 1)))).join(order.select("place", F.col(who).alias("target")), "place")
    other = other.where(F.col("target") != F.col(who)).withColumn("genuine", F.lit(False))
    pairs = own.select(key, "target", "genuine", "v").unionByName(other.select(key, "target", "genuine", "v"))
    return deviations(pairs, profiles.withColumnRenamed(who, "target"), pop, "target")
