"""Feature names in vector order.

Fixed values: names and order.
"""

from __future__ import annotations

from lurewatch.rules.lexicons import BANK_NAMES

HEADER = (
    "hdr_sender_present", "hdr_display_name_present", "hdr_brand_display_mismatch", "hdr_domain_is_lookalike",
    "hdr_sender_freemail", "hdr_sender_tld_high_risk", "hdr_sender_domain_digits", "hdr_sender_domain_len",
    "hdr_sender_subdomain_depth", "hdr_sender_local_entropy", "hdr_sender_local_len", "hdr_sender_local_digit_ratio",
    "hdr_recipient_count", "hdr_recipient_missing", "hdr_recipient_undisclosed", "hdr_same_domain_as_recipient",
    "hdr_date_missing",
)
URL = (
    "url_count", "url_unique_domains", "url_has_ip_literal", "url_has_shortener", "url_has_punycode",
    "url_has_userinfo", "url_has_credential_path", "url_has_high_risk_tld", "url_has_brand_mismatch",
    "url_has_anchor_mismatch", "url_has_dangerous_ext", "url_has_archive_ext", "url_has_hex_encoding",
    "url_deep_subdomain", "url_max_len", "url_mean_len", "url_https_ratio", "url_flag_density",
    "url_legit_domain_ratio",
)
PHONE = (
    "tel_count", "tel_toll_free", "tel_international", "tel_call_to_action", "tel_billing_pretext",
    "tel_callback_shape",
)
IDENTITY = (
    "emb_body_sender_count", "emb_body_sender_mismatch", "emb_bracket_cta", "emb_cta_without_url",
)
STATE = (
    "thr_claims_thread", "thr_msgid_resolved", "thr_quote_match", "thr_fabricated", "sty_scored", "sty_drift",
)
TEXT = (
    "txt_subject_len", "txt_subject_words", "txt_subject_upper_ratio", "txt_subject_is_reply", "txt_subject_exclaim",
    "txt_subject_empty", "txt_body_len", "txt_body_words", "txt_body_upper_ratio", "txt_body_exclaim_rate",
    "txt_body_question_rate", "txt_has_html", "txt_html_hidden_style", "txt_html_tag_ratio", "txt_zero_width_chars",
    "txt_homoglyph_chars", "txt_non_ascii_ratio", "txt_link_char_ratio", "txt_thread_hijack_marker",
    "txt_leet_tokens", "txt_intraword_punct_rate", "txt_spaced_letter_runs", "txt_repeat_char_runs",
    "txt_currency_mentions", "txt_all_caps_words", "txt_mean_word_len", "txt_unique_word_ratio",
)
ATTACHMENT = (
    "att_count", "att_dangerous_count", "att_archive_count", "att_double_extension", "att_dangerous_named_in_body",
    "att_any_named_in_body",
)


def feature_names(banks=None) -> list[str]:
    """All names in vector order; the lexicon part follows the banks in use."""
    names = tuple(banks or BANK_NAMES)
    lex = [f"lex_{n}_{s}" for n in names for s in ("count", "rate")] + [f"lexsubj_{n}" for n in names]
    return [*HEADER, *URL, *PHONE, *IDENTITY, *STATE, *TEXT, *ATTACHMENT, *lex]
