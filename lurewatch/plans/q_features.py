"""Registered queries: text features and scalar families (inventory 2.2 projections and 2.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.functions import body as B
from lurewatch.functions import lexicon as LX
from lurewatch.functions import sender as S
from lurewatch.functions import style as ST
from lurewatch.functions import threads as T
from lurewatch.functions import urls as U
from lurewatch.functions.common import collapse, extract_all, words
from lurewatch.functions.language import with_language
from lurewatch.plans.features import feature_names, prepare, with_evidence, with_features
from lurewatch.plans.memo import planned
from lurewatch.plans.views import table, view
from lurewatch.rules import dims, patterns as P
from lurewatch.rules.lexicons import BANK_NAMES

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@planned
def messages(spark, d) -> DataFrame:
    return view(spark, d, "messages")


@planned
def featured_text(spark, d) -> DataFrame:
    """Feature rows with their text."""
    return with_features(messages(spark, d), keep_text=True)


@planned
def featured(spark, d) -> DataFrame:
    return featured_text(spark, d).drop("body", "body_text")


@query
def msg_uid(spark, d):
    return messages(spark, d).select("message_id", T.message_uid(F.col("subject"), F.col("body")).alias("uid"))


@query
def msg_full_text(spark, d):
    text = B.full_text(F.col("subject"), F.col("body"))
    return messages(spark, d).select("message_id", F.md5(text).alias("text_md5"), F.length(text).cast("bigint").alias("n"))


@query
def fx_sender_parse(spark, d):
    return S.with_sender(messages(spark, d).select("message_id", "sender")).select(
        "message_id", "address", "display_name", "local_part", "domain")


@query
def fx_registrable(spark, d):
    df = S.with_sender(messages(spark, d).select("message_id", "sender"))
    return df.groupBy("domain", "registrable", "tld").agg(F.count("*").alias("n"))


@query
def fx_entropy(spark, d):
    local = S.with_sender(messages(spark, d).select("message_id", "sender"))
    return rounded(local.select("message_id", S.entropy(F.col("local_part")).alias("bits")))


@query
def fx_brand_claim(spark, d):
    return S.with_sender(messages(spark, d).select("message_id", "sender")).select(
        "message_id", "claimed_brand", "brand_mismatch")


@query
def fx_lookalike(spark, d):
    return S.with_sender(messages(spark, d).select("message_id", "sender")).select(
        "message_id", "registrable", "lookalike_of", F.col("lookalike_distance").cast("bigint").alias("lookalike_distance"))


@query
def fx_header_features(spark, d):
    df = S.with_sender(messages(spark, d).select("message_id", "sender", "receiver", "sent_at"))
    return rounded(df.select("message_id", *[c.alias(n) for n, c in S.header_features().items()]))


def _page_links(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html")
    pages = pages.withColumn("text", F.regexp_replace("html", P.HTML_TAG, " "))
    return U.with_urls(pages, "text", "html")


@query
def fx_url_extract(spark, d):
    """Links of raw pages: plain text and anchors."""
    return _page_links(spark, d).select("page_id", F.posexplode("urls").alias("pos", "u")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "u.raw", "u.anchor_text", "u.scheme", "u.host", "u.path",
        "u.registrable")


@query
def fx_url_flags(spark, d):
    df = U.with_urls(prepare(messages(spark, d)).select("message_id", "body_text", "body"))
    out = df.select("message_id", F.explode("urls").alias("u"))
    return out.select("message_id", "u.raw", *[F.col(f"u.{f}").alias(f) for f in U.FLAGS])


@query
def fx_url_features(spark, d):
    df = U.with_urls(prepare(messages(spark, d)).select("message_id", "body_text", "body"))
    return rounded(df.select("message_id", *[c.alias(n) for n, c in U.url_features().items()]))


def _phones(spark, d):
    df = prepare(messages(spark, d)).select("message_id", F.concat("subject", F.lit("\n"), "body_text").alias("text"))
    return df.withColumn("phones", B.phones(F.col("text")))


@query
def fx_phones(spark, d):
    return _phones(spark, d).select("message_id", F.explode("phones").alias("p")).select(
        "message_id", "p.raw", "p.digits", "p.toll_free", "p.international")


@query
def fx_phone_features(spark, d):
    return _phones(spark, d).select("message_id", *[c.alias(n) for n, c in B.phone_features(F.col("text")).items()])


@query
def fx_embedded_identity(spark, d):
    df = with_evidence(prepare(messages(spark, d)))
    return df.select("message_id", *[c.alias(n) for n, c in B.identity_features().items()])


@query
def fx_text_features(spark, d):
    df = prepare(messages(spark, d)).withColumn("body_words", words(F.lower("body_text")))
    return rounded(df.select("message_id", *[c.alias(n) for n, c in B.text_features().items()]))


@query
def fx_homoglyphs(spark, d):
    """Confusable-script letters per document, over the given prose."""
    df = table(spark, d, "documents").select("doc_id", "lang", B.homoglyphs(F.col("text")).cast("bigint").alias("n"))
    return df.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("confusable_letters"))


@query
def fx_attachments(spark, d):
    df = B.with_attachments(prepare(messages(spark, d)).select("message_id", "attachments", "body_text"))
    return df.select("message_id", *[c.alias(n) for n, c in B.attachment_features().items()],
                     F.array_join(B.evidence_files(), "|").alias("evidence"))


@query
def fx_lexicon_hits(spark, d):
    df = LX.with_hits(prepare(messages(spark, d)).select("message_id", "subject", "body_text"))
    return df.select("message_id", F.explode("hits").alias("h")).select(
        "message_id", "h.lexicon", "h.field", "h.term", F.col("h.start").cast("bigint").alias("span_start"),
        F.col("h.end").cast("bigint").alias("span_end"))


@query
def fx_lexicon_features(spark, d):
    df = prepare(messages(spark, d)).select("message_id", "subject", "body_text")
    df = LX.with_triggers(df).withColumn("n_words", F.size(words(F.col("body_text")))).withColumns(LX.lexicon_counts())
    df = df.withColumns(LX.lexicon_rates(F.col("n_words")))
    return rounded(df.select("message_id", *[n for n in feature_names() if n.startswith("lex")]))


@query
def fx_quotes(spark, d):
    """Up to two distinct quotes per message and bank, body hits before subject hits."""
    df = LX.with_hits(prepare(messages(spark, d)).select("message_id", "subject", "body_text"))
    df = df.withColumn("quoted", F.transform("hits", lambda h: F.struct(
        h.lexicon.alias("lexicon"),
        LX.quote(F.when(h.field == "subject", F.col("subject")).otherwise(F.col("body_text")), h.start, h.end).alias("q"))))
    df = df.select("message_id", "quoted", F.explode(F.array_distinct(F.transform("quoted", lambda x: x.lexicon))).alias("lexicon"))
    own = F.transform(F.filter("quoted", lambda x: x.lexicon == F.col("lexicon")), lambda x: x.q)
    df = df.withColumn("own", own).withColumn("keys", F.transform("own", lambda x: F.lower(x)))
    first = F.filter("own", lambda x, i: F.array_position("keys", F.lower(x)) == i + 1)
    return df.select("message_id", "lexicon", F.array_join(F.slice(first, 1, 2), " | ").alias("quotes"))


@query
def fx_auth_aligned(spark, d):
    df = S.with_sender(messages(spark, d).select("message_id", "sender", "auth_results", "reply_to"))
    return df.select("message_id", S.auth_aligned(F.col("auth_results"), F.col("registrable")).alias("authenticated"),
                     F.col("auth_results").rlike(P.AUTH_FAILED).alias("auth_failed"),
                     S.header_domain(F.col("reply_to")).alias("reply_domain"))


@query
def fx_language_script(spark, d):
    df = with_language(table(spark, d, "documents").select("doc_id", "text"), "text")
    return rounded(df.select("doc_id", "script", "script_lang", "script_share", F.col("letters").cast("bigint").alias("letters")))


@query
def fx_language_stopwords(spark, d):
    df = with_language(table(spark, d, "documents").select("doc_id", "text"), "text")
    return df.select("doc_id", "lang_detected", "is_english", "lang_confidence", F.col("n_words").cast("bigint").alias("n_words"))


@query
def fx_subject_norm(spark, d):
    return messages(spark, d).groupBy(T.subject_norm(F.col("subject")).alias("norm")).agg(F.count("*").alias("n"))


@query
def fx_quoted_text(spark, d):
    df = messages(spark, d).select("message_id", T.quoted_text(F.col("body")).alias("quoted"))
    return df.where("quoted <> ''").select("message_id", "quoted")


@query
def fx_msgids(spark, d):
    df = messages(spark, d).select("message_id", F.explode(T.message_ids(F.col("in_reply_to"))).alias("ref"))
    return df.select("message_id", "ref")


@query
def fx_shingles(spark, d):
    df = T.with_shingles(table(spark, d, "documents").select("doc_id", "text"), "text")
    return df.select("doc_id", F.size("shingles").cast("bigint").alias("n"), F.md5(
        F.array_join(F.array_sort("shingles"), " ")).alias("set_md5"))


@query
def fx_simhash(spark, d):
    docs = table(spark, d, "documents")
    return T.simhash(docs, "doc_id", F.col("text"))


@query
def fx_content_key(spark, d):
    return messages(spark, d).select("message_id", T.content_key(F.col("subject"), F.col("body")).alias("content_key"))


@query
def fx_readable_body(spark, d):
    own = ST.readable_body(F.col("body"))
    return messages(spark, d).select("message_id", F.md5(own).alias("own_md5"), F.length(own).cast("bigint").alias("n"))


@query
def fx_style_traits(spark, d):
    df = ST.with_traits(table(spark, d, "documents").select("doc_id", "text"), "text")
    return rounded(df.select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), *ST.TRAIT_NAMES), 4)


@query
def fx_style_traits_all(spark, d):
    """All 125 traits."""
    df = ST.with_traits(table(spark, d, "documents").select("doc_id", "text"), "text")
    return rounded(df.select("doc_id", *ST.TRAIT_NAMES))


@query
def fx_money_patterns(spark, d):
    df = prepare(messages(spark, d))
    both = F.lower(F.concat("subject", F.lit(" "), "body_text"))
    return df.select(
        "message_id", F.regexp_count("body_text", F.lit(P.CURRENCY)).cast("bigint").alias("sums"),
        both.rlike(P.TEXT_FLAGS["pat_money_ask"]).alias("money_ask"),
        both.rlike(P.TEXT_FLAGS["pat_gift_card_ask"]).alias("gift_card_ask"),
        F.col("sender").rlike(P.OFFICIAL_DISPLAY).alias("official_sender"))


@query
def fx_quoted_secret(spark, d):
    """Secrets quoted in prose and the hash prefix they would be looked up by."""
    df = table(spark, d, "documents").select("doc_id", F.regexp_extract("text", P.QUOTED_SECRET, 1).alias("secret"))
    digest = F.upper(F.sha1("secret"))
    return df.select("doc_id", (F.col("secret") != "").alias("found"), F.when(
        F.col("secret") != "", F.left(digest, F.lit(5))).otherwise(F.lit("")).alias("prefix"))


@query
def fx_parse_date(spark, d):
    from lurewatch.sources.mail import parse_rfc2822
    df = messages(spark, d).select("message_id", F.when(F.col("message_id") % 17 == 0, F.lit("not a date")).otherwise(
        F.concat(F.date_format("sent_at", "EEE, dd MMM yyyy HH:mm:ss"), F.when(
            F.col("message_id") % 3 == 0, F.lit(" +0200 (CEST)")).otherwise(F.lit(" GMT")))).alias("raw"))
    df = df.withColumn("utc", parse_rfc2822(F.col("raw")))
    return df.select("message_id", "raw", F.coalesce(F.date_format("utc", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("utc"),
                     F.hour("utc").cast("bigint").alias("hour"), F.weekday("utc").cast("bigint").alias("weekday"))


@query
def fx_age_buckets(spark, d):
    from lurewatch.operators.enrich import age_buckets
    df = S.with_sender(messages(spark, d).select("message_id", "sender", "sent_at"))
    return age_buckets(df, view(spark, d, "domain_registry"), F.to_date("sent_at")).select(
        "message_id", "dom_age_known", "dom_age_days", "dom_age_under_30d", "dom_age_under_180d")


@query
def fx_file_type(spark, d):
    """Declared extension against first bytes. The bytes are derived from each message's digest."""
    from lurewatch.operators.enrich import file_types
    sig = F.element_at(F.array(*[F.lit(h) for h, _, _ in dims.MAGIC_BYTES], F.lit("00000000")),
                       (F.col("message_id") % (len(dims.MAGIC_BYTES) + 1) + 1).cast("int"))
    df = messages(spark, d).where("attachments <> ''").select(
        "message_id", F.explode(B.split_attachments(F.col("attachments"))).alias("filename"), F.concat(
            sig, F.upper(F.md5(F.col("message_id").cast("string")))).alias("head_hex"))
    return file_types(df, F.col("filename"), F.col("head_hex"))


@query
def features_all(spark, d):
    """Every named feature of every message."""
    return rounded(featured(spark, d).select("message_id", *feature_names()))


@query
def src_html_text(spark, d):
    from lurewatch.sources.corpora import html_text
    return table(spark, d, "pages").select("page_id", F.md5(html_text(F.col("html"))).alias("text_md5"),
                                           F.length(html_text(F.col("html"))).cast("bigint").alias("n"))


@query
def flt_word_count(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    return docs.where(F.col("n_words").between(25, 400)).select("doc_id", "n_words")


@query
def flt_readable(spark, d):
    """Drop list traffic, markup, spaced punctuation and tokenised text."""
    body = collapse(F.col("body"))
    df = messages(spark, d).select("message_id", "subject", body.alias("body"))
    letters = F.length(F.regexp_replace("body", r"\P{L}+", ""))
    capitals = F.length(F.regexp_replace("body", r"\P{Lu}+", ""))
    df = df.select("message_id", "subject", "body", letters.alias("letters"), capitals.alias("capitals"), F.regexp_count(
        "body", F.lit(r"\s[:,.;!?]\s")).alias("spaced"))
    keep = ~(
        F.col("subject").rlike(P.LIST_SUBJECT) | F.col("subject").rlike(P.LIST_TRAFFIC) | F.col("body").rlike(P.LIST_TRAFFIC)
        | (F.col("letters") < F.length("body") * 0.55) | (F.col("spaced") > 4) | (F.col("capitals") < F.col("letters") * 0.01))
    return df.where(keep).select("message_id", F.col("letters").cast("bigint").alias("letters"),
                                 F.col("capitals").cast("bigint").alias("capitals"))


@query
def agg_marker_precision(spark, d):
    """Per marker: hits by class and precision."""
    from lurewatch.operators.evaluate import marker_precision
    df = featured(spark, d)
    return rounded(marker_precision(df, "label", {n: F.col(f"lex_{n}_count") + F.col(f"lexsubj_{n}") > 0 for n in BANK_NAMES}))
