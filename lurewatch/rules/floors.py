"""Deterministic floors as a table: each row lifts the probability to at least its minimum when its predicate holds.

Predicates are plain comparisons over the feature columns, written as SQL expressions so that the table reads as data.
Fixed values: names, minima, thresholds and the implied vector.
"""

from __future__ import annotations

from typing import NamedTuple


class Floor(NamedTuple):
    name: str
    minimum: str
    when: str
    vector: str | None
    why: str


PAY = "lex_payment_count >= 1"
CRED = "lex_credential_request_count >= 1"
MONEY = "lex_money_request_count >= 1"
_DELIVERY = "(lex_delivery_scam_count + lexsubj_delivery_scam)"
_CHARITY = "(lex_charity_fraud_count + lexsubj_charity_fraud)"
_NO_TARGET = "(url_count = 0 OR emb_cta_without_url > 0)"
_NEW_DOMAIN_ASK = f"({PAY} OR {CRED} OR {MONEY} OR url_count >= 1)"

FLOORS: tuple[Floor, ...] = (
    Floor("executable_attachment", "0.95", "att_dangerous_count > 0", "malware_delivery",
          "an attached file runs when opened"),
    Floor("double_extension", "0.95", "att_double_extension > 0", "malware_delivery",
          "a file hides its real type behind a document extension"),
    Floor("executable_link", "0.90", "exec_link", "malware_delivery", "a link leads straight to a program"),
    Floor("password_protected_archive", "0.90", "att_archive_count > 0 AND pat_archive_password", "malware_delivery",
          "the text supplies the password of an attached archive"),
    Floor("macro_enable_lure", "0.92", "att_count > 0 AND pat_macro", "malware_delivery",
          "the reader is told to switch macros on"),
    Floor("gift_card_request", "0.88", "pat_gift_card_ask", "bec_payment_fraud", "gift cards are asked for"),
    Floor("bec_triad", "0.88",
          f"{PAY} AND lex_secrecy_count >= 1 AND (lex_authority_count >= 1 OR lex_urgency_count >= 1)",
          "bec_payment_fraud", "payment, secrecy and pressure together"),
    Floor("freemail_payment_request", "0.80",
          f"{PAY} AND hdr_sender_freemail > 0 AND hdr_display_name_present > 0", "bec_payment_fraud",
          "a named person asks for payment from a free mailbox"),
    Floor("bank_detail_change", "0.85", f"pat_bank_changed AND {PAY}", "vendor_invoice_fraud",
          "bank details are said to have changed"),
    Floor("reply_to_divergence", "0.85",
          "reply_domain <> '' AND registrable <> '' AND reply_domain <> registrable AND NOT authenticated "
          f"AND NOT established AND ({PAY} OR {CRED})", "bec_payment_fraud", "answers would go to another domain"),
    Floor("failed_authentication_with_lure", "0.88",
          f"auth_failed AND ({PAY} OR {CRED} OR hdr_brand_display_mismatch > 0)", "credential_phishing",
          "sender authentication failed on a message with a lure"),
    Floor("return_path_mismatch", "0.80",
          "return_domain <> '' AND registrable <> '' AND return_domain <> registrable AND NOT authenticated "
          f"AND ({PAY} OR hdr_brand_display_mismatch > 0)", "credential_phishing", "bounces go to another domain"),
    Floor("unsolicited_money_request", "CASE WHEN lex_identity_claim_count > 0 THEN 0.85 ELSE 0.80 END",
          "pat_money_ask AND txt_currency_mentions >= 1 AND txt_body_words <= 150 AND txt_thread_hijack_marker = 0 "
          "AND txt_subject_is_reply = 0 AND (hdr_sender_freemail > 0 OR NOT authenticated)", "advance_fee_fraud",
          "a short cold message asks for a sum of money"),
    Floor("first_contact_ask", "0.82", f"first_contact AND NOT authenticated AND ({PAY} OR {MONEY} OR {CRED})", None,
          "the first message from this domain asks for money or credentials"),
    Floor("first_contact_attachment", "0.80", "first_contact AND att_count > 0 AND NOT authenticated", None,
          "the first message from this domain carries a file"),
    Floor("brand_new_domain", "0.88", f"domain_age_days < 30 AND {_NEW_DOMAIN_ASK}", "credential_phishing",
          "the sending domain is days old"),
    Floor("young_domain_credential_ask", "0.80",
          f"domain_age_days < 180 AND ({CRED} OR hdr_brand_display_mismatch > 0) "
          f"AND NOT (domain_age_days < 30 AND {_NEW_DOMAIN_ASK})", "credential_phishing",
          "a young domain asks for credentials or borrows a brand"),
    Floor("delivery_pretext_no_link", "0.80", f"{_DELIVERY} >= 3 AND NOT authenticated AND {_NO_TARGET}",
          "delivery_scam", "a delivery story with nothing to inspect"),
    Floor("delivery_fee_request", "0.82",
          f"NOT ({_DELIVERY} >= 3 AND {_NO_TARGET}) AND {_DELIVERY} >= 2 AND NOT authenticated AND ({PAY} OR {MONEY})",
          "delivery_scam", "a delivery story that asks for a fee"),
    Floor("unverified_charity_appeal", "0.78",
          f"{_CHARITY} >= 4 AND NOT authenticated AND ({MONEY} OR txt_currency_mentions > 0)", "charity_fraud",
          "an appeal for money from a sender that did not prove who it is"),
    Floor("callback_phishing_shape", "0.88", "tel_callback_shape > 0 AND url_count = 0", "callback_phishing",
          "a billing story and a number to ring, with nothing to click"),
    Floor("remote_access_tool_named", "0.85", "pat_remote_tool AND NOT authenticated", "tech_support_scam",
          "a remote-access product is named"),
    Floor("dormant_sender_returns", "0.80",
          f"dormant_days >= 365 AND ({PAY} OR {CRED} OR {MONEY} OR att_count > 0)", "bec_payment_fraud",
          "a long silent domain comes back with a request"),
    Floor("off_rhythm_send_time", "0.75", f"unusual_hour AND NOT authenticated AND ({PAY} OR {CRED})",
          "bec_payment_fraud", "sent at an hour this sender never used"),
    Floor("fabricated_thread", "0.90",
          "thr_fabricated > 0 AND history_scanned AND NOT (corresponded AND hist_received >= 3)",
          "credential_phishing", "quotes a conversation the mailbox has no trace of"),
    Floor("body_sender_mismatch", "0.85", f"emb_body_sender_mismatch > 0 AND ({CRED} OR {PAY} OR {MONEY})",
          "credential_phishing", "the body names another sender than the envelope"),
    Floor("lookalike_sender_domain", "0.85",
          "hdr_domain_is_lookalike > 0 AND length(registrable) >= 9 "
          "AND lookalike_distance <= (CASE WHEN length(registrable) < 12 THEN 1 ELSE 2 END)", "credential_phishing",
          "the sending domain is a near miss of a real one"),
    Floor("brand_impersonation", "0.85",
          f"hdr_brand_display_mismatch > 0 AND official_display AND ({CRED} OR url_has_anchor_mismatch > 0)",
          "credential_phishing", "an official-sounding brand name on a foreign domain"),
    Floor("link_text_mismatch", "0.85", "url_has_anchor_mismatch > 0 AND NOT authenticated AND NOT established",
          "credential_phishing", "link text and link target name different domains"),
    Floor("homoglyph_or_punycode", "0.82", "txt_homoglyph_chars >= 6 OR sender_punycode", "credential_phishing",
          "lookalike characters imitate a real name"),
    Floor("qr_credential_lure", "0.85", f"pat_qr AND ({CRED} OR lex_it_support_count > 0)", "credential_phishing",
          "a QR code carries the credential lure"),
    Floor("signin_page_on_abuse_tld", "0.88",
          f"url_has_credential_path > 0 AND url_has_high_risk_tld > 0 AND {CRED}", "credential_phishing",
          "a sign-in page on a high-abuse top-level domain"),
)
FLOOR_VECTOR = {f.name: f.vector for f in FLOORS if f.vector}
