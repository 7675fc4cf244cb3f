"""Attack vectors: impact and technique ids, in fixed key order (ties between votes fall to the earlier key).

Fixed values: impacts, technique ids, key order, exposure weights and scoring constants.
"""

from __future__ import annotations

# vector, display name, impact, technique ids
VECTORS = (
    ("bec_payment_fraud", "BEC payment fraud", 1.00, ("T1566.002", "T1534", "T1656")),
    ("vendor_invoice_fraud", "Vendor invoice fraud", 0.92, ("T1566.001", "T1656")),
    ("malware_delivery", "Malware delivery", 0.95, ("T1566.001", "T1204.002", "T1027")),
    ("credential_phishing", "Credential phishing", 0.85, ("T1566.002", "T1056.003", "T1111")),
    ("extortion", "Extortion", 0.55, ("T1657",)),
    ("advance_fee_fraud", "Advance-fee fraud", 0.45, ("T1566.002",)),
    ("recon_probe", "Reconnaissance probe", 0.40, ("T1598", "T1597")),
    ("callback_phishing", "Callback phishing", 0.85, ("T1566", "T1598.004", "T1219")),
    ("tech_support_scam", "Tech-support scam", 0.75, ("T1566", "T1219")),
    ("investment_fraud", "Investment fraud", 0.70, ("T1566.002", "T1657")),
    ("job_scam", "Job scam", 0.60, ("T1566.002", "T1598")),
    ("government_impersonation", "Government impersonation", 0.65, ("T1566.002", "T1656")),
    ("delivery_scam", "Delivery scam", 0.50, ("T1566.002",)),
    ("romance_fraud", "Romance fraud", 0.60, ("T1566.003", "T1585")),
    ("charity_fraud", "Charity fraud", 0.40, ("T1566.002",)),
    ("spam_unwanted", "Unwanted bulk mail", 0.15, ()),
    ("malicious_unclassified", "Unclassified malicious", 0.70, ("T1566",)),
    ("benign", "Benign", 0.00, ()),
)
VECTOR_KEYS = tuple(v[0] for v in VECTORS)
DEFAULT_IMPACT = 0.70

# vector -> (recipient exposure area, weight)
VECTOR_EXPOSURE = {
    "bec_payment_fraud": ("finance", 0.35),
    "vendor_invoice_fraud": ("finance", 0.30),
    "callback_phishing": ("finance", 0.20),
    "credential_phishing": ("credentials", 0.30),
    "malware_delivery": ("credentials", 0.15),
    "government_impersonation": ("finance", 0.15),
    "job_scam": ("hr", 0.20),
    "investment_fraud": ("finance", 0.15),
}

BANDS = ((90.0, "CRITICAL"), (70.0, "HIGH"), (40.0, "MEDIUM"), (15.0, "LOW"), (0.0, "INFORMATIONAL"))
BAND_RANK = {"INFORMATIONAL": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}

W_IMPACT, W_EXPLOIT, W_TARGET = 0.50, 0.30, 0.20
ESC_IOC, ESC_EXEC, ESC_THREAD = 25.0, 10.0, 8.0
TRAIN_PRIOR, ODDS_EPS = 0.49, 1e-9

# feature, weight: added where the feature is above zero, sum capped at 1
EXPLOIT_WEIGHTS = (
    ("url_has_credential_path", 0.35), ("att_dangerous_count", 0.40), ("att_double_extension", 0.30),
    ("url_has_dangerous_ext", 0.35), ("url_has_anchor_mismatch", 0.20), ("url_has_brand_mismatch", 0.20),
    ("lex_payment_count", 0.25), ("lex_credential_request_count", 0.20), ("url_count", 0.10),
    ("att_archive_count", 0.15),
)
TARGET_WEIGHTS = (
    ("txt_thread_hijack_marker", 0.30), ("hdr_same_domain_as_recipient", 0.25), ("hdr_brand_display_mismatch", 0.15),
    ("lex_authority_count", 0.20), ("txt_subject_is_reply", 0.10), ("lex_secrecy_count", 0.15),
)

# Response plans and postures: our own wording, one line per step.
PLAYBOOK = {
    "bec_payment_fraud": "hold the payment|call the requester on a known number|search for sibling messages",
    "vendor_invoice_fraud": "hold the invoice|confirm bank details with the vendor by phone|review recent changes",
    "malware_delivery": "isolate hosts that opened the file|collect the file hash|block the delivery host",
    "credential_phishing": "reset exposed passwords|revoke sessions|block the landing domain",
    "extortion": "do not pay|preserve the message|check for reused passwords",
    "advance_fee_fraud": "do not reply|block the sender",
    "recon_probe": "do not reply|watch for a follow-up",
    "callback_phishing": "do not call|warn recipients|block the number where possible",
    "tech_support_scam": "do not call|check for remote-access tools",
    "investment_fraud": "do not transfer funds|report the platform",
    "job_scam": "do not send documents or fees|report the posting",
    "government_impersonation": "verify with the authority's own site|report the impersonation",
    "delivery_scam": "check the courier's own site|block the link",
    "romance_fraud": "do not send money|report the profile",
    "charity_fraud": "check the charity register|report the appeal",
    "spam_unwanted": "block the sender|adjust the bulk filter",
    "malicious_unclassified": "send to an analyst",
    "benign": "no action",
}
POSTURE = {
    "CRITICAL": "respond now", "HIGH": "respond within the hour", "MEDIUM": "review today",
    "LOW": "review in the queue", "INFORMATIONAL": "log only",
}
