"""Labelling functions as a table: each row votes for one vector with a weight, or stays silent.

Fixed values: names, vectors, weights and thresholds. `L(x)` counts bank x in body and subject.
"""

from __future__ import annotations

from typing import NamedTuple


class Vote(NamedTuple):
    lf: str
    vector: str
    weight: str
    when: str


def L(bank: str) -> str:
    return f"(lex_{bank}_count + lexsubj_{bank})"


SPAM = f"({L('spam_adult')} + {L('spam_pharma')} + {L('spam_finance')} + {L('spam_commercial')})"
QUIET = f"{L('credential_request')} = 0 AND {L('payment')} = 0"
_BANK = f"(pat_bank_words AND {L('payment')} >= 1)"
_SUPPLIER = "(pat_invoice OR pat_supplier)"
_SEXT = f"({L('sextortion')} >= 2 OR ({L('sextortion')} >= 1 AND {L('crypto')} >= 1))"
_LURES = " + ".join(
    L(b) for b in ("sextortion", "crypto", "threat", "reward", "payment", "credential_request", "it_support",
                   "attachment_lure", "romance")
)

# corpus -> (vector, weight)
SOURCE_PRIOR = {
    "nigerian_fraud": ("advance_fee_fraud", 2.5),
    "enron_spam": ("spam_unwanted", 0.8),
    "spamassassin": ("spam_unwanted", 0.5),
}

VOTES: tuple[Vote, ...] = (
    Vote("lf_dangerous_attachment", "malware_delivery", "3.0", "att_dangerous_count > 0 OR att_double_extension > 0"),
    Vote("lf_executable_named", "malware_delivery", "1.6",
         "att_dangerous_count = 0 AND att_double_extension = 0 AND att_dangerous_named_in_body > 0"),
    Vote("lf_executable_link", "malware_delivery", "2.2", "url_has_dangerous_ext > 0"),
    Vote("lf_macro_lure", "malware_delivery", "2.4", "pat_macro_or_view"),
    Vote("lf_archive_lure", "malware_delivery", "1.4", f"{L('attachment_lure')} >= 1 AND url_has_archive_ext > 0"),
    Vote("lf_password_archive", "malware_delivery", "2.5", "att_archive_count > 0 AND pat_password_word"),
    Vote("lf_sextortion", "extortion", "3.0", _SEXT),
    Vote("lf_crypto_threat", "extortion", "1.8",
         f"NOT {_SEXT} AND {L('crypto')} >= 1 AND {L('threat')} >= 1 AND txt_body_words < 700"),
    Vote("lf_advance_fee", "advance_fee_fraud", "2.2", f"{L('reward')} >= 2 AND txt_body_words > 120"),
    Vote("lf_419_narrative", "advance_fee_fraud", "2.6", f"{L('reward')} >= 1 AND pat_inheritance"),
    Vote("lf_romance_fraud", "advance_fee_fraud", "1.5", f"{L('romance')} >= 2 AND {L('reward')} >= 1"),
    Vote("lf_bank_change", "vendor_invoice_fraud", "2.8", f"{_BANK} AND {_SUPPLIER}"),
    Vote("lf_bank_change_weak", "vendor_invoice_fraud", "1.2",
         f"{_BANK} AND NOT {_SUPPLIER} AND {L('secrecy')} = 0 AND {L('authority')} = 0"),
    Vote("lf_invoice_attachment", "vendor_invoice_fraud", "1.6",
         f"NOT {_BANK} AND pat_invoice AND ({L('attachment_lure')} >= 1 OR att_count > 0)"),
    Vote("lf_bec_payment", "bec_payment_fraud", f"CASE WHEN {L('secrecy')} >= 1 THEN 2.4 ELSE 1.9 END",
         f"{L('payment')} >= 1 AND ({L('authority')} >= 1 OR {L('secrecy')} >= 1) AND url_count <= 1 "
         "AND txt_body_words < 400"),
    Vote("lf_gift_card", "bec_payment_fraud", "2.6", "pat_gift_card_words"),
    Vote("lf_exec_pressure", "bec_payment_fraud", "1.7",
         f"{L('authority')} >= 1 AND {L('secrecy')} >= 1 AND {L('urgency')} >= 1 AND url_count = 0"),
    Vote("lf_payroll_diversion", "bec_payment_fraud", "2.7", "pat_payroll AND pat_new_bank"),
    Vote("lf_credential_link", "credential_phishing", "CASE WHEN url_has_credential_path > 0 THEN 2.6 ELSE 1.8 END",
         f"{L('credential_request')} >= 1 AND url_count >= 1"),
    Vote("lf_brand_spoof_link", "credential_phishing", "2.3",
         "url_count >= 1 AND NOT authenticated AND (hdr_brand_display_mismatch > 0 OR url_has_brand_mismatch > 0)"),
    Vote("lf_it_support_link", "credential_phishing", "1.9", f"{L('it_support')} >= 1 AND url_count >= 1"),
    Vote("lf_qr_credential_lure", "credential_phishing", "2.5",
         f"pat_qr AND ({L('credential_request')} >= 1 OR {L('it_support')} >= 1)"),
    Vote("lf_anchor_mismatch", "credential_phishing", "2.1", "url_has_anchor_mismatch > 0 AND NOT authenticated"),
    Vote("lf_callback_shape", "callback_phishing", "3.0", "tel_callback_shape > 0"),
    Vote("lf_phone_only_lure", "callback_phishing", "2.0",
         "tel_callback_shape = 0 AND tel_count >= 1 AND tel_call_to_action > 0 AND url_count = 0 AND att_count = 0 "
         f"AND ({L('threat')} > 0 OR {L('payment')} > 0)"),
    Vote("lf_tech_support", "tech_support_scam", "CASE WHEN tel_count > 0 THEN 2.8 ELSE 2.0 END",
         f"{L('tech_support_scam')} >= 2"),
    Vote("lf_remote_access_tool", "tech_support_scam", "2.6", "pat_remote_tool"),
    Vote("lf_investment_promise", "investment_fraud", "2.4", f"{L('investment_scam')} >= 2"),
    Vote("lf_crypto_investment", "investment_fraud", "2.2",
         f"{L('investment_scam')} < 2 AND {L('investment_scam')} >= 1 AND {L('crypto')} >= 1"),
    Vote("lf_job_offer", "job_scam", "CASE WHEN pat_job_fee THEN 2.6 ELSE 2.0 END", f"{L('job_scam')} >= 2"),
    Vote("lf_offplatform_move", "job_scam", "2.4", f"{L('job_scam')} >= 1 AND pat_messenger"),
    Vote("lf_govt_impersonation", "government_impersonation", "2.5", f"{L('govt_impersonation')} >= 2"),
    Vote("lf_govt_threat", "government_impersonation", "2.2",
         f"{L('govt_impersonation')} < 2 AND {L('govt_impersonation')} >= 1 AND {L('threat')} >= 1"),
    Vote("lf_delivery_hold", "delivery_scam",
         f"CASE WHEN {L('payment')} >= 1 OR url_count >= 1 THEN 2.5 ELSE 1.8 END", f"{L('delivery_scam')} >= 3"),
    Vote("lf_charity_appeal", "charity_fraud", "2.0", f"{L('charity_fraud')} >= 4"),
    Vote("lf_romance_money", "romance_fraud", "2.6",
         f"{L('romance')} >= 2 AND ({L('reward')} >= 1 OR {L('payment')} >= 1 OR {L('money_request')} >= 1 "
         f"OR {L('crypto')} >= 1)"),
    Vote("lf_adult_spam", "spam_unwanted", "2.2", f"{L('spam_adult')} >= 2"),
    Vote("lf_pharma_spam", "spam_unwanted", "2.2", f"{L('spam_pharma')} >= 2"),
    Vote("lf_finance_spam", "spam_unwanted", "2.0", f"{L('spam_finance')} >= 2"),
    Vote("lf_commercial_spam", "spam_unwanted", "1.9", f"{L('spam_commercial')} >= 2"),
    Vote("lf_commercial_weak", "spam_unwanted", "0.9", f"{SPAM} = 1 AND {QUIET} AND {L('sextortion')} = 0"),
    Vote("lf_bulk_footer", "spam_unwanted", "1.2", f"{L('spam_bulk_marker')} >= 1 AND {QUIET} AND {SPAM} >= 1"),
    Vote("lf_dating_spam", "spam_unwanted", "1.1",
         f"{L('romance')} >= 2 AND {L('reward')} = 0 AND {L('payment')} = 0"),
    Vote("lf_obfuscated_bulk", "spam_unwanted", "1.3",
         "(txt_intraword_punct_rate > 0.12 OR txt_spaced_letter_runs >= 2 OR txt_leet_tokens >= 4) "
         f"AND {QUIET}"),
    Vote("lf_contentless_opener", "recon_probe", "CASE WHEN pat_opener THEN 2.0 ELSE 1.0 END",
         f"txt_body_words < 30 AND url_count = 0 AND att_count = 0 AND ({_LURES} + {SPAM}) <= 1"),
) + tuple(
    Vote("lf_corpus_prior", vec, str(w), f"source = '{src}'") for src, (vec, w) in SOURCE_PRIOR.items()
)
