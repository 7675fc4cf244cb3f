"""Phones, claimed identities, attachments and the structural text features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.common import count_char, count_matches, extract_all, extract_where, flag, kept_length, member, only_ascii, ratio, words
from lurewatch.functions.sender import domain_of, registrable
from lurewatch.rules import dims, patterns as P


def strip_tags(body: Column) -> Column:
    return F.when(body.contains("<"), F.regexp_replace(body, P.HTML_TAG, " ")).otherwise(body)


def full_text(subject: Column, body: Column) -> Column:
    return F.concat(subject, F.lit("\n\n"), strip_tags(body))


# ---- phones
def phones(text: Column) -> Column:
    """array of (raw, digits, toll_free, international), first spelling per digit string."""
    found = F.transform(extract_all(text, P.PHONE_START + P.PHONE), lambda r: F.struct(
        F.trim(r).alias("raw"), F.regexp_replace(r, r"\D", "").alias("digits")))
    sized = F.filter(found, lambda p: F.length(p.digits).between(7, 15))
    keys = F.transform(sized, lambda p: p.digits)
    first = F.filter(sized, lambda p, i: F.array_position(keys, p.digits) == i + 1)

    def describe(p):
        core = F.when(p.digits.startswith("1") & (F.length(p.digits) == 11), F.substring(p.digits, 2, 20)).otherwise(p.digits)
        return F.struct(p.raw.alias("raw"), p.digits.alias("digits"),
                        member(F.left(core, F.lit(3)), dims.TOLL_FREE).alias("toll_free"),
                        p.raw.startswith("+").alias("international"))
    return F.transform(first, describe)


def phone_features(text: Column, may_call: Column | None = None, may_bill: Column | None = None) -> dict[str, Column]:
    """Phone features; the two guards may be false only where their pattern cannot match."""
    ph = F.col("phones")
    cta, bill = (p if test is None else test & p for test, p in (
        (may_call, text.rlike(P.CALL_TO_ACTION)), (may_bill, text.rlike(P.BILLING_PRETEXT))))
    return {
        "tel_count": F.size(ph).cast("double"),
        "tel_toll_free": flag(F.exists(ph, lambda p: p.toll_free)),
        "tel_international": flag(F.exists(ph, lambda p: p.international)),
        "tel_call_to_action": flag(cta),
        "tel_billing_pretext": flag(bill),
        "tel_callback_shape": flag((F.size(ph) > 0) & cta & bill),
    }


# ---- identity asserted in the body
def claimed_addresses(body: Column, envelope: Column) -> Column:
    """Addresses after From/Email/Sender/Reply-To labels in the head of the message, other than the envelope's."""
    lines = extract_all(F.substring(body, 1, 500), P.BODY_FROM, 1)
    found = F.flatten(F.transform(lines, lambda l: extract_all(F.lower(l), P.CLAIMED_ADDRESS)))
    return F.array_distinct(F.filter(found, lambda a: a != envelope))


def bracket_ctas(body: Column) -> Column:
    found = extract_where(body.contains("["), body, P.BRACKET_CTA, 1)
    return F.slice(F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: t != ""), 1, 5)


def with_identity(df: DataFrame) -> DataFrame:
    df = df.withColumn("claimed_addresses", claimed_addresses(F.col("body_text"), F.col("address")))
    df = df.withColumn("claimed_domains", F.array_distinct(F.filter(
        F.transform("claimed_addresses", lambda a: registrable(domain_of(a))), lambda d: d != "")))
    return df.withColumn("bracket_ctas", bracket_ctas(F.col("body_text")))


def identity_features() -> dict[str, Column]:
    doms, reg = F.col("claimed_domains"), F.col("registrable")
    return {
        "emb_body_sender_count": F.size("claimed_addresses").cast("double"),
        "emb_body_sender_mismatch": flag((F.size(doms) > 0) & (reg != "") & ~F.array_contains(doms, reg)),
        "emb_bracket_cta": F.size("bracket_ctas").cast("double"),
        "emb_cta_without_url": flag((F.size("bracket_ctas") > 0) & (F.size("urls") == 0)),
    }


# ---- attachments
def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def split_attachments(piped: Column) -> Column:
    return F.filter(F.split(F.coalesce(piped, F.lit("")), r"\|"), lambda n: n != "")


def with_attachments(df: DataFrame) -> DataFrame:
    names = F.col("attachment_names")
    shown = F.concat(F.col("body_text"), F.lit(" "), F.array_join(names, " "))
    df = df.withColumns({
        "attachment_names": split_attachments(F.col("attachments")),
        "files_in_body": extract_where(F.col("body_text").rlike(P.FILENAME_GUARD), F.col("body_text"), P.FILENAME),
    })
    return df.withColumns({
        "double_ext_files": F.array_distinct(extract_where(shown.rlike(P.DOUBLE_EXT_GUARD), shown, P.DOUBLE_EXT)),
        "dangerous_in_body": F.filter("files_in_body", lambda n: member(extension(n), dims.DANGEROUS_EXT)),
        "dangerous_files": F.filter(names, lambda n: member(extension(n), dims.DANGEROUS_EXT)),
    })


def evidence_files() -> Column:
    """Dangerous attachments, then dangerous names in the body; first spelling per lower-cased name."""
    both = F.concat("dangerous_files", "dangerous_in_body")
    keys = F.transform(both, lambda n: F.lower(n))
    return F.filter(both, lambda n, i: F.array_position(keys, F.lower(n)) == i + 1)


def attachment_features() -> dict[str, Column]:
    names = F.col("attachment_names")
    return {
        "att_count": F.size(names).cast("double"),
        "att_dangerous_count": F.size("dangerous_files").cast("double"),
        "att_archive_count": F.size(F.filter(names, lambda n: member(extension(n), dims.ARCHIVE_EXT))).cast("double"),
        "att_double_extension": F.size("double_ext_files").cast("double"),
        "att_dangerous_named_in_body": F.size("dangerous_in_body").cast("double"),
        "att_any_named_in_body": F.size("files_in_body").cast("double"),
    }


# ---- text shape
def upper_ratio(text: Column, is_ascii: Column) -> Column:
    dense = F.replace(text, F.lit(" "), F.lit(""))

    def share(other, letters):  # each count is made once
        return F.coalesce(F.try_divide(kept_length(text, other), F.length(dense) - kept_length(dense, letters)), F.lit(0.0))
    return F.when(is_ascii, share("[^A-Z]+", "[A-Za-z]++")).otherwise(share(r"[^\p{Lu}]+", r"\p{L}++"))


def all_caps_words(text: Column) -> Column:
    """Words over three characters that have a capital and no small letter."""
    unlowered = extract_all(text, r"(?=[^\s\p{Ll}]{4})(?<!\S)[^\s\p{Ll}]{4,}+(?!\S)")
    return F.size(F.filter(unlowered, lambda x: (x == F.upper(x)) & (x != F.lower(x)))).cast("double")


def homoglyphs(text: Column) -> Column:
    return kept_length(text, "[^" + P.CONFUSABLE + "]+")


def text_features() -> dict[str, Column]:
    """27 shape features; needs subject, body, body_text (tags stripped) and body_words (lower case)."""
    subj, body, vis, w = F.col("subject"), F.col("body"), F.col("body_text"), F.col("body_words")
    n = F.greatest(F.size(w), F.lit(1))
    has_html = F.coalesce(body.rlike(P.HTML_TAG), F.lit(False))
    is_ascii = only_ascii(subj) & only_ascii(vis)
    zero = F.lit(0.0)
    return {
        "txt_subject_len": F.length(subj).cast("double"),
        "txt_subject_words": F.size(words(subj)).cast("double"),
        "txt_subject_upper_ratio": upper_ratio(subj, is_ascii),
        "txt_subject_is_reply": flag(subj.rlike(P.REPLY_SUBJECT)),
        "txt_subject_exclaim": count_char(subj, "!").cast("double"),
        "txt_subject_empty": flag(~subj.rlike(r"\S")),
        "txt_body_len": F.length(vis).cast("double"),
        "txt_body_words": F.size(w).cast("double"),
        "txt_body_upper_ratio": upper_ratio(vis, is_ascii),
        "txt_body_exclaim_rate": count_char(vis, "!") / n,
        "txt_body_question_rate": count_char(vis, "?") / n,
        "txt_has_html": flag(has_html),
        "txt_html_hidden_style": F.when(has_html, flag(body.rlike(P.HIDDEN_STYLE))).otherwise(zero),
        "txt_html_tag_ratio": F.when(has_html, count_matches(body, P.HTML_TAG) / n).otherwise(zero),
        "txt_zero_width_chars": F.when(~only_ascii(body) & body.rlike(P.ZERO_WIDTH), count_matches(body, P.ZERO_WIDTH)).otherwise(zero),
        "txt_homoglyph_chars": F.when(~is_ascii & F.concat(subj, vis).rlike(P.CONFUSABLE_START + "[" + P.CONFUSABLE + "]"), homoglyphs(
            F.concat(subj, F.lit(" "), vis)).cast("double")).otherwise(zero),
        "txt_non_ascii_ratio": F.when(is_ascii, zero).otherwise(
            ratio(kept_length(vis, P.NON_ASCII_DROP), F.length(vis))),
        "txt_link_char_ratio": (F.length(body) - F.length(F.regexp_replace(body, P.LINK_TEXT, "")))
        / F.greatest(F.length(body), F.lit(1)),
        "txt_thread_hijack_marker": flag(body.rlike(P.THREAD_MARKER)),
        "txt_leet_tokens": F.when(vis.rlike(P.LEET_GUARD), count_matches(vis, P.LEET)).otherwise(zero),
        "txt_intraword_punct_rate": count_matches(vis, P.INTRAWORD_PUNCT) / n,
        "txt_spaced_letter_runs": count_matches(vis, P.SPACED_LETTERS),
        "txt_repeat_char_runs": count_matches(vis, P.REPEAT_RUN),
        "txt_currency_mentions": F.when(vis.rlike(P.CURRENCY_START + "(?:" + P.CURRENCY_GUARD + ")"), count_matches(vis, P.CURRENCY_START + P.CURRENCY)).otherwise(zero),
        "txt_all_caps_words": all_caps_words(vis),
        "txt_mean_word_len": F.length(F.array_join(w, "")) / n,
        "txt_unique_word_ratio": F.size(F.array_distinct(w)) / n,
    }
