"""Exact explanations of additive scorers: token weights, view shares, linear attributions, counterfactuals, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The features a counterfactual may switch off, in order; at most six per message.
CANDIDATES = ("url_has_anchor_mismatch", "url_has_credential_path", "hdr_brand_display_mismatch", "hdr_domain_is_lookalike",
              "att_dangerous_count", "lex_credential_request_count", "lex_payment_count", "lex_urgency_count", "lex_threat_count",
              "url_has_shortener", "txt_homoglyph_chars", "lex_secrecy_count")
MAX_PROBES = 6

# Our own wording for what a feature means.
LABELS = {
    "url_has_anchor_mismatch": "link text and link target differ", "url_has_credential_path": "a link leads to a sign-in page",
    "hdr_brand_display_mismatch": "the name borrows a brand the domain does not own", "hdr_domain_is_lookalike": "the domain is a near miss of a real one",
    "att_dangerous_count": "an attachment runs when opened", "lex_credential_request_count": "credentials are asked for",
    "lex_payment_count": "a payment is asked for", "lex_urgency_count": "time pressure", "lex_threat_count": "a threat",
    "url_has_shortener": "a link hides its target", "txt_homoglyph_chars": "lookalike characters", "lex_secrecy_count": "secrecy is asked for",
}
# A fixed linear scorer over the candidates, used where no trained model is at hand.
LINEAR = {n: round(0.4 + 0.15 * i, 2) for i, n in enumerate(CANDIDATES)}
INTERCEPT = -1.0


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def linear_logit(weights=LINEAR, intercept: float = INTERCEPT) -> Column:
    out = F.lit(intercept)
    for n, w in weights.items():
        out = out + F.lit(w) * F.col(n)
    return out


def token_contributions(tf: DataFrame, weights: DataFrame, n: int = 15) -> DataFrame:
    """coefficient x tf-idf per token of each message, ranked. Only tokens with a weight survive the join, so a message's
    group is bounded by its distinct weighted tokens."""
    df = tf.join(weights, "token").withColumn("contribution", F.col("weight") * F.col("tfidf"))
    w = Window.partitionBy("message_id").orderBy(F.desc(F.abs("contribution")), "token")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("message_id", "token", "contribution", "rank")


def attributions(df: DataFrame, means: dict[str, float], weights=LINEAR) -> DataFrame:
    """Long (message_id, feature, value, contribution) rows: weight x (value - mean)."""
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value"), (F.lit(w) * (F.col(n) - F.lit(means[n]))).alias("contribution")) for n, w in weights.items()])
    return df.select("message_id", F.explode(rows).alias("a")).select("message_id", "a.*")


def ranked(att: DataFrame, n: int = 40) -> DataFrame:
    """Largest absolute contributions first. A message has one row per feature, so the window is bounded."""
    w = Window.partitionBy("message_id").orderBy(F.desc(F.abs("contribution")), "feature")
    return att.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def counterfactuals(df: DataFrame, weights=LINEAR, intercept: float = INTERCEPT) -> DataFrame:
    """Re-score with one present feature at zero. Row-local: the probes are an array, exploded after scoring."""
    logit = linear_logit(weights, intercept)
    probes = F.slice(F.filter(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value"), F.lit(weights[n]).alias("w")) for n in CANDIDATES]),
                              lambda x: x.value > 0), 1, MAX_PROBES)
    df = df.select("message_id", logit.alias("z"), F.explode(probes).alias("f"))
    after = F.col("z") - F.col("f.w") * F.col("f.value")
    return df.select("message_id", "f.feature", sigmoid(F.col("z")).alias("p"), sigmoid(after).alias("p_without"))


def view_share(structural: Column, wording: Column, w_s: float, w_w: float) -> tuple[Column, Column]:
    a, b = F.abs(structural * w_s), F.abs(wording * w_w)
    tot = F.when(a + b > 0, a + b).otherwise(F.lit(1.0))
    return a / tot, b / tot


def findings(att: DataFrame, n: int = 4) -> DataFrame:
    """Attributions as sentences, strongest first; a feature that is zero is stated as absent."""
    from lurewatch.functions.common import string_map
    label = F.element_at(string_map(LABELS.items()), F.col("feature"))
    text = F.when(F.col("value") > 0, F.concat(label, F.format_string(" (%+.2f)", "contribution"))).otherwise(
        F.concat(F.lit("no sign that "), label, F.format_string(" (%+.2f)", "contribution")))
    return ranked(att, n).select("message_id", "rank", text.alias("finding"))
