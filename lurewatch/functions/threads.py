"""Conversation fingerprints: subjects, quoted text, message ids, word shingles, content keys and SimHash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.common import extract_all
from lurewatch.rules import patterns as P

SHINGLE_WORDS, SHINGLE_LIMIT = 5, 400
SIMHASH_WORDS = 3


def subject_norm(subject: Column) -> Column:
    cut = F.lower(F.regexp_replace(F.trim(subject), r"(?i)^\s*(?:re|fw|fwd)\s*:\s*", ""))
    return F.left(F.trim(F.regexp_replace(cut, "[^a-z0-9 ]+", "")), F.lit(80))


def quoted_text(body: Column) -> Column:
    """Text after `>` marks; with none, up to 1500 characters after an attribution line."""
    lines = F.filter(F.transform(extract_all(body, P.QUOTED_LINE, 1), lambda l: F.trim(l)), lambda l: l != "")
    after = F.trim(F.left(F.element_at(F.split(body, P.QUOTE_INTRO, 2), -1), F.lit(1500)))
    return (
        F.when(body.rlike(r"(?m)^\s*>"), F.array_join(lines, " "))
        .when(body.rlike(P.QUOTE_INTRO), after)
        .otherwise(F.lit(""))
    )


def message_ids(references: Column) -> Column:
    return F.transform(extract_all(references, P.MESSAGE_ID, 1), lambda m: F.lower(m))


def tokens(text: Column) -> Column:
    return extract_all(F.lower(text), P.WORD_TOKEN)


def shingles_of(toks: Column) -> Column:
    """Distinct short hashes of the 5-word shingles at the first 400 positions."""
    n = F.least(F.size(toks) - (SHINGLE_WORDS - 1), F.lit(SHINGLE_LIMIT))
    made = F.transform(F.sequence(F.lit(1), n), lambda i: F.left(
        F.md5(F.array_join(F.slice(toks, i, F.lit(SHINGLE_WORDS)), " ")), F.lit(12)))
    return F.when(n >= 1, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def with_shingles(df: DataFrame, text: str, out: str = "shingles") -> DataFrame:
    return df.withColumn("_toks", tokens(F.col(text))).withColumn(out, shingles_of(F.col("_toks"))).drop("_toks")


def content_key(subject: Column, body: Column) -> Column:
    blob = F.regexp_replace(F.lower(F.concat(subject, F.lit(" "), body)), "[^a-z0-9]+", " ")
    return F.sha1(F.left(F.trim(blob), F.lit(400)))


def message_uid(subject: Column, body: Column) -> Column:
    head = F.concat(subject.cast("binary"), F.unhex(F.lit("00")), F.left(body, F.lit(20000)).cast("binary"))
    return F.left(F.sha2(head, 256), F.lit(16))


def simhash(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, simhash): sign of the bit sums over all 3-word shingles of the whole text, 0 below three words.

    Two 32-bit lanes share one BIGINT sum, so the aggregate holds 32 sums instead of 64. Shingles of one text stay in
    one task until the map-side partial sum, so only one row per text is shuffled.
    """
    toks = df.select(key, tokens(text).alias("t"))
    grams = toks.select(key, F.explode_outer(F.when(F.size("t") >= SIMHASH_WORDS, F.transform(
        F.sequence(F.lit(1), F.size("t") - (SIMHASH_WORDS - 1)),
        lambda i: F.array_join(F.slice("t", i, F.lit(SIMHASH_WORDS)), " ")))).alias("g"))
    hashed = grams.select(key, "g", F.md5("g").alias("h")).select(
        key, "g",
        F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint").alias("hi"),
        F.conv(F.substring("h", 9, 8), 16, 10).cast("bigint").alias("lo"))

    def lane(b):
        bit = F.shiftright("hi", b).bitwiseAND(F.lit(1))
        return F.shiftleft(bit, 32).bitwiseOR(F.shiftright("lo", b).bitwiseAND(F.lit(1)))

    sums = hashed.groupBy(key).agg(F.count("g").alias("n"), *[F.sum(lane(b)).alias(f"s{b}") for b in range(32)])
    low = F.lit(0xFFFFFFFF).cast("bigint")

    def word(part):
        out = F.lit(0).cast("bigint")
        for b in range(32):
            out = out.bitwiseOR(F.when(part(b) * 2 > F.col("n"), F.lit(1 << b).cast("bigint")).otherwise(F.lit(0)))
        return out

    hi = word(lambda b: F.shiftrightunsigned(f"s{b}", 32))
    lo = word(lambda b: F.col(f"s{b}").bitwiseAND(low))
    halves = sums.select(key, "n", F.coalesce(hi, F.lit(0)).alias("hi"), F.coalesce(lo, F.lit(0)).alias("lo"))
    value = F.shiftleft("hi", 32).bitwiseOR(F.col("lo"))
    return halves.select(key, F.when(F.col("n") == 0, F.lit(0)).otherwise(value).cast("bigint").alias("simhash"))
