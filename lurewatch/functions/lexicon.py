"""Lexicon counts and exact spans."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.common import collapse, extract_all, strings
from lurewatch.rules import patterns as P
from lurewatch.rules.lexicons import at_first_chars, compile_banks, prefix_free, word_seeds, word_start_pattern


def with_triggers(df: DataFrame, banks=None) -> DataFrame:
    """Add body_low, subject_low, both_text and `triggers`: the seed literals that begin a word in subject or body.

    One pass over the word starts finds the seeds of every bank, text flag and guarded feature; a pattern of these then runs
    only on rows that hold one of its seeds. A pattern that has no seeds always runs.
    """
    df = df.withColumns({"body_low": F.lower("body_text"), "subject_low": F.lower("subject")})
    df = df.withColumn("both_text", F.concat("subject_low", F.lit(" "), "body_low"))
    found = extract_all(F.col("both_text"), word_start_pattern(all_seeds(banks)), 1)
    return df.withColumn("triggers", F.array_distinct(found))


def all_seeds(banks=None) -> tuple[str, ...]:
    """The literals looked for at word starts."""
    return _seeds_of((*compile_banks(banks).values(), *P.TEXT_FLAGS.values(), P.CALL_TO_ACTION, P.BILLING_PRETEXT))


@lru_cache(64)
def _seeds_of(patterns: tuple[str, ...]) -> tuple[str, ...]:
    return prefix_free(v for p in patterns for v in (word_seeds(p) or ((), ()))[0])


def guard(pattern: str, banks=None) -> Column:
    """False only where the pattern cannot match subject, body or both with white space between them."""
    own = word_seeds(pattern)
    if not own:
        return F.lit(True)
    begin, inside = own
    tests = [F.col("both_text").contains(v) for v in inside]
    if begin:
        short = sorted({t for t in all_seeds(banks) for v in begin if v.startswith(t)})
        tests.insert(0, F.arrays_overlap("triggers", strings(short)))
    return reduce(lambda a, b: a | b, tests)


def guarded_count(text: Column, pattern: str, banks=None) -> Column:
    n = F.regexp_count(text, F.lit(at_first_chars(pattern))).cast("double")
    return F.when(guard(pattern, banks), n).otherwise(F.lit(0.0))


def text_flags(banks=None) -> dict[str, Column]:
    """The phrase flags on subject and body; needs `with_triggers`."""
    return {n: guard(p, banks) & F.col("both_text").rlike(p) for n, p in P.TEXT_FLAGS.items()}


def lexicon_counts(banks=None) -> dict[str, Column]:
    """Counts per bank in body and subject; needs `with_triggers`."""
    pats = compile_banks(banks)
    out = {f"lex_{n}_count": guarded_count(F.col("body_text"), p, banks) for n, p in pats.items()}
    return out | {f"lexsubj_{n}": guarded_count(F.col("subject"), p, banks) for n, p in pats.items()}


def lexicon_rates(n_words: Column, banks=None) -> dict[str, Column]:
    return {f"lex_{n}_rate": F.col(f"lex_{n}_count") * 1000.0 / F.greatest(n_words, F.lit(1)) for n in compile_banks(banks)}


def spans(text: Column, lexicon: str, pattern: str, field: str, banks=None) -> Column:
    """array of (lexicon, field, term, start, end). Offsets come from the gaps between matches and the matches."""
    terms = extract_all(text, pattern)
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(terms.alias("term"), F.slice(gaps, F.lit(1), F.size(terms)).alias("gap"))
    start = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<term:string,start:int>>").alias("out")),
        lambda acc, z: F.struct(
            (acc.pos + F.length(z["gap"]) + F.length(z["term"])).alias("pos"),
            F.concat(acc.out, F.array(F.struct(z["term"].alias("term"), (acc.pos + F.length(z["gap"])).alias("start")))).alias("out")),
        lambda acc: acc.out)
    made = F.transform(start, lambda s: F.struct(
        F.lit(lexicon).alias("lexicon"), F.lit(field).alias("field"), s.term.alias("term"), s.start.alias("start"),
        (s.start + F.length(s.term)).alias("end")))
    none = F.array().cast("array<struct<lexicon:string,field:string,term:string,start:int,end:int>>")
    return F.when(guard(pattern, banks) & text.rlike(pattern), made).otherwise(none)


def any_hit(text: Column, only: tuple[str, ...], banks=None) -> Column:
    """A span of one of the banks is in the text; the scan ends at the first one."""
    pats = compile_banks(banks)
    return text.rlike("|".join(f"(?:{pats[n]})" for n in only))


def with_hits(df: DataFrame, banks=None, only: tuple[str, ...] | None = None) -> DataFrame:
    """Add `hits`: every span, body banks first, then subject banks, in bank order."""
    pats = {k: v for k, v in compile_banks(banks).items() if only is None or k in only}
    arrays = [spans(F.col("body_text"), n, p, "body", banks) for n, p in pats.items()]
    arrays += [spans(F.col("subject"), n, p, "subject", banks) for n, p in pats.items()]
    return with_triggers(df, banks).withColumn("hits", F.concat(*arrays)).drop("body_low", "subject_low", "both_text", "triggers")


def quote(text: Column, start: Column, end: Column, pad: int = 45) -> Column:
    """The span with `pad` characters around it, whitespace collapsed, ellipses where text was cut."""
    lo = F.greatest(F.lit(0), start - pad)
    hi = F.least(F.length(text), end + pad)
    return F.concat(F.when(lo > 0, F.lit("…")).otherwise(F.lit("")), collapse(F.substring(text, lo + 1, hi - lo)),
                    F.when(hi < F.length(text), F.lit("…")).otherwise(F.lit("")))
