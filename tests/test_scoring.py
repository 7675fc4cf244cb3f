"""Floors, votes and severity on small hand-written messages and as invariants over whole tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import scoring as SC
from lurewatch.plans.features import feature_names, with_features
from lurewatch.plans.scoring import score
from lurewatch.plans.views import view

SF = "/root/testdata/sf0.001"
MAIL = [
    (1, "Boss <ceo@gmail.com>", "Quick favour", "I need you to buy gift cards today. This is strictly confidential, the CEO asks urgently.", "", "", ""),
    (2, "PayPal Support <help@paypa1.com>", "Account", "Please verify your account at https://login.paypa1.com/verify now", "", "mx; spf=fail smtp.mailfrom=paypa1.com", ""),
    (3, "Ann <ann@example.org>", "Lunch", "Shall we have lunch on Friday at the usual place with the team?", "", "mx; dkim=pass header.d=example.org", ""),
    (4, "Bob <bob@example.org>", "Scan", "Please see the file", "scan.pdf.exe", "", ""),
    (5, "Shop <a@shop.example>", "Deal", '<a href="http://evil.top/x">https://www.hsbc.com</a>', "", "", ""),
    (6, "x", "", "", "", "", ""),
    (7, "Vendor <v@vendor.example>", "Invoice", "Our bank details have changed, send the wire transfer for the outstanding invoice.", "", "", "<a@other.example>"),
]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, s, "me@corp.example", sub, b, att, auth, rep, datetime(2024, 1, 1, 9)) for i, s, sub, b, att, auth, rep in MAIL]
    df = spark.createDataFrame(rows, "message_id bigint, sender string, receiver string, subject string, body string, attachments string, auth_results string, reply_to string, sent_at timestamp")
    out = score(df, p=F.lit(0.1))
    return {r["message_id"]: r for r in out.collect()}


def fired(row):
    return {f["name"] for f in row["floors"]}


def test_every_message_is_scored(scored):
    assert set(scored) == {m[0] for m in MAIL}


def test_gift_card_and_triad(scored):
    assert {"gift_card_request", "bec_triad", "freemail_payment_request"} <= fired(scored[1])
    assert scored[1]["p_final"] == pytest.approx(0.88) and scored[1]["vector"] == "bec_payment_fraud"


def test_lookalike_and_failed_authentication(scored):
    r = scored[2]
    assert r["lookalike_of"] == "paypal.com" and r["brand_mismatch"]
    assert {"lookalike_sender_domain", "failed_authentication_with_lure"} <= fired(r)


def test_ordinary_mail_is_left_alone(scored):
    assert not scored[3]["floors"] and scored[3]["verdict"] == "BENIGN" and scored[3]["severity"] == 0.0


def test_double_extension(scored):
    assert {"executable_attachment", "double_extension"} <= fired(scored[4]) and scored[4]["vector"] == "malware_delivery"


def test_anchor_mismatch(scored):
    assert scored[5]["url_has_anchor_mismatch"] == 1.0 and "link_text_mismatch" in fired(scored[5])


def test_empty_message(scored):
    assert scored[6]["address"] == "" and scored[6]["txt_body_words"] == 0.0


def test_bank_change_and_reply_divergence(scored):
    assert {"bank_detail_change", "reply_to_divergence"} <= fired(scored[7])


def test_feature_vector_is_stable_and_ordered():
    names = feature_names()
    assert len(names) == 163 and len(set(names)) == 163 and names[0] == "hdr_sender_present"


def test_prior_is_bayes_and_floors_ignore_it(spark):
    df = view(spark, SF, "messages")
    out = score(df, p=F.col("hdr_sender_present") * 0.3 + 0.2, prior=0.02).select("p_model", "p_prior", "p_final", "binding", "severity", "band")
    bad = out.where((F.col("p_final") < F.col("p_prior")) | (F.col("p_prior") >= F.col("p_model")) | (F.size("binding") > 0) & (F.col("p_final") < 0.75))
    assert bad.count() == 0


def test_bands_follow_severity(spark):
    rows = score(view(spark, SF, "messages"), p=F.lit(0.3)).select("severity", SC.band_rank(F.col("band")).alias("r")).orderBy("severity").collect()
    ranks = [r["r"] for r in rows]
    assert ranks == sorted(ranks)


def test_text_columns_match_unguarded_counts(spark):
    """The literal prefilter never changes a count."""
    from lurewatch.rules.lexicons import compile_banks
    pats = compile_banks()
    df = with_features(view(spark, SF, "messages"), keep_text=True)
    diff = [F.count_if(F.regexp_count("body_text", F.lit(p)) != F.col(f"lex_{n}_count")).alias(n) for n, p in pats.items()]
    assert all(v == 0 for v in df.agg(*diff).first())
