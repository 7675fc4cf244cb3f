"""The wide feature row. One narrow plan per message: no explode, no shuffle, each costly step its own projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.functions import body as B
from lurewatch.functions import lexicon as LX
from lurewatch.functions import sender as S
from lurewatch.functions import threads as T
from lurewatch.functions import urls as U
from lurewatch.functions.common import words
from lurewatch.rules import patterns as P
from lurewatch.rules.feature_names import STATE, feature_names  # noqa: F401

KEEP = ("message_id", "mailbox", "source", "sender", "receiver", "sent_at", "subject", "attachments", "in_reply_to",
        "kind", "label")
OPTIONAL = {"reply_to": "", "return_path": "", "auth_results": "", "attachments": "", "in_reply_to": "",
            "mailbox": "", "source": "unknown", "subject": "", "body": "", "receiver": "", "sender": ""}


def prepare(df: DataFrame) -> DataFrame:
    """Fill absent or NULL text columns and add the tag-free body."""
    for name, default in OPTIONAL.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default))
    return df.withColumn("body_text", B.strip_tags(F.col("body")))


def with_evidence(df: DataFrame, allowlist: tuple[str, ...] = ()) -> DataFrame:
    """Nested evidence columns every feature is read from: sender, links, phones, identities, files, authentication."""
    df = S.with_sender(df)
    df = U.with_urls(df)
    df = df.withColumn("phones", B.phones(F.concat("subject", F.lit("\n"), "body_text")))
    df = B.with_attachments(B.with_identity(df))
    reg = F.col("registrable")
    allow = lambda c: c.isin(*allowlist) if allowlist else F.lit(False)
    return df.withColumns({
        "authenticated": S.auth_aligned(F.col("auth_results"), reg),
        "auth_failed": F.col("auth_results").rlike(P.AUTH_FAILED),
        "reply_domain": S.header_domain(F.col("reply_to")),
        "return_domain": S.header_domain(F.col("return_path")),
        "official_display": F.col("display_name").rlike(P.OFFICIAL_DISPLAY),
        "sender_punycode": F.col("domain").contains("xn--"),
        "exec_link": U.hard_executable_link(allow(reg), allow),
    })


def with_features(df: DataFrame, banks=None, allowlist: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """Messages in, one row of named features, flags and evidence per message out. Bodies are dropped unless kept."""
    df = with_evidence(prepare(df), allowlist)
    phone_text = F.concat("subject", F.lit("\n"), "body_text")
    df = LX.with_triggers(df, banks)
    df = df.withColumns({**S.header_features(), **U.url_features(), **B.identity_features(), **B.attachment_features(),
                         **B.phone_features(phone_text, LX.guard(P.CALL_TO_ACTION, banks), LX.guard(P.BILLING_PRETEXT, banks))})
    df = df.withColumn("body_words", words(F.col("body_low")))
    df = df.withColumns(B.text_features()).withColumns({**LX.lexicon_counts(banks), **LX.text_flags(banks)})
    df = df.withColumns(LX.lexicon_rates(F.col("txt_body_words"), banks))
    claims = (F.col("txt_subject_is_reply") > 0) | (F.col("in_reply_to") != "") | (T.quoted_text(F.col("body")) != "")
    df = df.withColumn("thr_claims_thread", claims.cast("double"))
    for name in STATE[1:]:
        df = df.withColumn(name, F.lit(0.0)) if name not in df.columns else df
    drop = ["body_words", "both_text", "body_low", "subject_low", "triggers"] + ([] if keep_text else ["body", "body_text"])
    return df.drop(*drop)
