"""How somebody writes: rates of function words, punctuation and layout that do not depend on the topic.

Fixed values: the function words, trait names, patterns and thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.common import count_char, count_matches, extract_all, fence, flag, kept_length, words
from lurewatch.rules import patterns as P

MIN_TOKENS, MIN_MESSAGES, MIN_TRAITS, SUSPICIOUS = 80, 12, 10, 1.16

FUNCTION_WORDS = (
    "a about after all also an and any are as at be because been but by can could did do for from get had has have "
    "here how i if in into is it its just know like make may me more most much my no not now of on only or other our "
    "out over should so some such than that the their them then there these they this those through to up us very was "
    "we well what when which while who will with would you your"
).split()
PUNCTUATION = {
    "comma": ",", "period": ".", "semicolon": ";", "colon": ":", "exclaim": "!", "question": "?", "apostrophe": "'",
    "quote": '"', "paren": "(", "slash": "/", "ampersand": "&",
}
CONTRACTION = (
    r"(?i)\b(?:i'm|i've|i'd|i'll|you're|you've|we're|we've|they're|it's|that's|there's|here's|don't|doesn't|didn't|"
    r"won't|can't|cannot|couldn't|shouldn't|wouldn't|isn't|aren't|wasn't|weren't|haven't|hasn't|hadn't|let's|what's|"
    r"who's)\b"
)
CONTRACTION_START = "(?=[A-Za-z]{1,8}+'|(?i:cannot))"  # a look-ahead test put before it, as those in `patterns`
GREETINGS = {
    "dear": r"(?i)^\s*dear\b", "hi": r"(?i)^\s*hi\b", "hello": r"(?i)^\s*hello\b", "hey": r"(?i)^\s*hey\b",
    "good": r"(?i)^\s*good\s+(?:morning|afternoon|evening)\b", "name_only": r"(?i)^\s*[A-Z][a-z]+\s*[,:-]",
}
SIGNOFFS = {
    "thanks": r"(?im)\b(?:thanks|thank you|thx)\b\s*[,.!]*\s*$",
    "regards": r"(?im)\b(?:regards|best regards|kind regards|br)\b\s*[,.!]*\s*$",
    "best": r"(?im)\bbest\b\s*[,.!]*\s*$",
    "cheers": r"(?im)\bcheers\b\s*[,.!]*\s*$",
    "sincerely": r"(?im)\b(?:sincerely|yours)\b\s*[,.!]*\s*$",
}
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
SENTENCE_BREAK = r"""[.!?]+[\s"')\]]+|\n{2,}"""
SENTENCE_START = r"(?:^|[.!?]\s+)([A-Za-z])"
STYLE_NAMES = ("st_sentence_len", "st_sentence_sd", "st_word_len", "st_long_words", "st_hapax", "st_allcaps",
               "st_contractions", "st_digits", "st_emoji", "st_blank_lines", "st_line_len", "st_double_space", "st_lower_start")
TRAIT_NAMES = (
    *[f"fw_{w}" for w in FUNCTION_WORDS], *[f"pn_{p}" for p in PUNCTUATION], *STYLE_NAMES,
    *[f"gr_{g}" for g in GREETINGS], "gr_none", *[f"sg_{g}" for g in SIGNOFFS],
)


def readable_body(text: Column) -> Column:
    """The sender's own words: cut at a quote intro, drop quoted lines, cut at the signature, blank links and addresses.

    What is cut always leaves a line end before it, so a text without the signs of a link or an address has none afterwards."""
    own = F.get(F.split(text, P.STYLE_QUOTE_INTRO, 2), F.lit(0))
    own = F.regexp_replace(own, P.STYLE_QUOTED_LINE, "")
    own = F.get(F.split(own, P.STYLE_SIGNATURE, 2), F.lit(0))
    own = F.when(text.contains("://") | text.contains("www."), F.regexp_replace(own, P.STYLE_URL, " ")).otherwise(own)
    own = F.when(text.contains("@"), F.regexp_replace(own, P.STYLE_EMAIL, " ")).otherwise(own)
    return F.regexp_replace(own, r"^\s+|\s+$", "")


def times(spaced: str, word: str) -> Column:
    """How often a word stands between two spaces in a text where each word has its own two."""
    rest = F.replace(F.col(spaced), F.lit(f" {word} "), F.lit(""))
    return ((F.octet_length(spaced) - F.octet_length(rest)) / (len(word) + 2)).cast("int")


def with_traits(df: DataFrame, text: str) -> DataFrame:
    """Add the 125 trait columns; rows under 80 words are left out. One pass per text, no shuffle."""
    df = df.withColumn("own", readable_body(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn("toks", extract_all(F.lower("own"), P.STYLE_TOKEN)).withColumn("n_tokens", F.size("toks"))
    df = fence(df, "n_tokens").where(F.col("n_tokens") >= MIN_TOKENS)
    own, toks, n = F.col("own"), F.col("toks"), F.col("n_tokens")
    fw = F.filter(toks, lambda t: t.isin(*FUNCTION_WORDS))
    df = df.withColumns({
        "fw_hits": F.concat(F.lit(" "), F.array_join(fw, "  "), F.lit(" ")),  # a token holds no space
        "all_toks": F.array_join(toks, ""),  # a token is ASCII
        "sorted_toks": F.sort_array(toks),
        "signs": F.regexp_replace(own, "[^" + "".join(PUNCTUATION.values()) + "]+", ""),
        "n_chars_own": F.greatest(F.length(own), F.lit(1)),
        "lines": F.split(own, "\n"),
        "sentence_lens": F.transform(F.filter(F.split(own, SENTENCE_BREAK), lambda s: s.rlike(r"\S")),
                                     lambda s: F.regexp_count(s, F.lit(r"[A-Za-z']+"))),
        "own_words": words(own),
        "starts": extract_all(own, SENTENCE_START, 1),
    })
    lines, lens, ch = F.col("lines"), F.col("sentence_lens"), F.col("n_chars_own")
    df = df.withColumns({
        "mean_len": F.aggregate(lens, F.lit(0), lambda a, x: a + x) / F.size(lens),
        "first_line": F.coalesce(F.get(F.filter(lines, lambda l: l.rlike(r"\S")), F.lit(0)), F.lit("")),
        "tail": F.array_join(F.slice(lines, F.greatest(F.size(lines) - 3, F.lit(1)), F.lit(4)), "\n"),
    })
    hapax = F.size(F.filter(F.col("sorted_toks"), lambda t, i: (
        F.coalesce(F.get("sorted_toks", i - 1) != t, F.lit(True)) & F.coalesce(F.get("sorted_toks", i + 1) != t, F.lit(True)))))
    caps = F.size(F.filter("own_words", lambda w: (F.length(w) > 2) & (w != F.lower(w)) & (w == F.upper(w))))
    mean = F.col("mean_len")
    out = {f"fw_{w}": 1000.0 * times("fw_hits", w) / n for w in FUNCTION_WORDS}
    out |= {f"pn_{k}": 1000.0 * count_char(F.col("signs"), c) / ch for k, c in PUNCTUATION.items()}
    out |= {
        "st_sentence_len": mean,
        "st_sentence_sd": F.sqrt(F.aggregate(lens, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(lens)),
        "st_word_len": F.octet_length("all_toks") / n,
        "st_long_words": 100.0 * F.size(F.filter(toks, lambda t: F.octet_length(t) > 6)) / n,
        "st_hapax": 100.0 * hapax / n,
        "st_allcaps": 100.0 * caps / F.greatest(F.size("own_words"), F.lit(1)),
        "st_contractions": 1000.0 * count_matches(own, CONTRACTION_START + CONTRACTION) / n,
        "st_digits": 100.0 * kept_length(own, "[^0-9]+") / ch,
        "st_emoji": 1000.0 * count_matches(own, EMOJI) / n,
        "st_blank_lines": 100.0 * F.size(F.filter(lines, lambda l: ~l.rlike(r"\S"))) / F.size(lines),
        "st_line_len": F.aggregate(lines, F.lit(0), lambda a, l: a + F.length(l)) / F.size(lines),
        "st_double_space": 100.0 * count_matches(own, r"[.!?]  +") / F.greatest(count_matches(own, r"[.!?] "), F.lit(1.0)),
        "st_lower_start": 100.0 * F.size(F.filter("starts", lambda c: c == F.lower(c))) / F.greatest(F.size("starts"), F.lit(1)),
    }
    out |= {f"gr_{k}": flag(F.col("first_line").rlike(p)) for k, p in GREETINGS.items()} | {"gr_none": F.lit(0.0)}
    out |= {f"sg_{k}": flag(F.col("tail").rlike(p)) for k, p in SIGNOFFS.items()}
    return df.withColumns({k: v.cast("double") for k, v in out.items()}).drop(
        "own", "toks", "fw_hits", "all_toks", "sorted_toks", "signs", "n_chars_own", "lines", "sentence_lens", "own_words", "starts", "mean_len",
        "first_line", "tail")
