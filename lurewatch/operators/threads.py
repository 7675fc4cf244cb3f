"""Did the quoted conversation happen? Ids, subjects and shingles of a mailbox, seen strictly before each message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.threads import shingles_of, tokens
from lurewatch.operators.skew import prefix_before

MIN_INDEX, MIN_MATCH, MIN_QUOTED_TOKENS = 200, 0.25, 25


def shingle_rows(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    return df.select(*keys, tokens(F.col(text)).alias("_t")).select(*keys, F.explode(shingles_of(F.col("_t"))).alias("shingle"))


def shingle_index(df: DataFrame) -> DataFrame:
    """First sighting and owner of every shingle per mailbox. A shingle every message holds (a footer) is folded by the
    map-side minimum, so it costs one row per task."""
    rows = shingle_rows(df, ["mailbox", "message_id", "sent_at"], "body")
    return rows.groupBy("mailbox", "shingle").agg(
        F.min("sent_at").alias("first_seen"), F.min(F.struct("sent_at", "message_id")).alias("o")).select(
        "mailbox", "shingle", "first_seen", F.col("o.message_id").alias("owner"))


def quote_match(df: DataFrame, index: DataFrame) -> DataFrame:
    """Per message: quoted shingles, and how many the mailbox held strictly before it."""
    asked = shingle_rows(df, ["mailbox", "message_id", "sent_at"], "quoted")
    hit = asked.join(index.select("mailbox", "shingle", "first_seen"), ["mailbox", "shingle"], "left")
    seen = F.coalesce(F.col("first_seen") < F.col("sent_at"), F.lit(False))
    return hit.groupBy("message_id").agg(F.count("*").alias("q_shingles"), F.count_if(seen).alias("q_found"))


def index_size(df: DataFrame) -> DataFrame:
    """How many messages the mailbox held strictly before each one."""
    out = prefix_before(df.select("mailbox", "message_id", "sent_at"), ["mailbox"], F.unix_micros("sent_at"), None,
                        {"indexed": ("sum", F.lit(1).cast("bigint"))})
    return out.select("message_id", "indexed")


def verify(df: DataFrame, min_index: int = MIN_INDEX) -> DataFrame:
    """Thread verdict per message of (mailbox, message_id, sent_at, body, quoted): the index grows in date order, so a
    message never vouches for itself or for anything earlier than it."""
    sized = index_size(df)
    matched = quote_match(df, shingle_index(df))
    n_tok = F.size(tokens(F.col("quoted")))
    out = df.select("mailbox", "message_id", "sent_at", (F.col("quoted") != "").alias("claims_thread"), n_tok.alias("q_tokens"))
    out = out.join(sized, "message_id").join(matched, "message_id", "left")
    ratio = F.when(F.col("q_shingles") > 0, F.col("q_found") / F.col("q_shingles")).otherwise(F.lit(0.0))
    out = out.withColumn("quote_match", ratio)
    enough = F.col("indexed") >= min_index
    found = F.col("quote_match") >= MIN_MATCH
    return out.withColumns({
        "matched": F.col("claims_thread") & enough & found,
        "fabricated": F.col("claims_thread") & enough & ~found & (F.col("q_tokens") >= MIN_QUOTED_TOKENS),
        "indeterminate": F.col("claims_thread") & (~enough | (~found & (F.col("q_tokens") < MIN_QUOTED_TOKENS))),
    }).drop("q_shingles", "q_found")


def resolve_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Messages with an In-Reply-To or References id the index holds."""
    refs = df.select("message_id", F.explode("refs").alias("ref"))
    return refs.join(ids.select(F.col("id").alias("ref")), "ref", "left_semi").select("message_id").distinct()
