"""Text patterns behind features, floors and votes.

Fixed values: formats and phrases that decide whether a flag fires. They are read by Java's engine on the Spark side.
Where a pattern needs look-around, `*_PLAIN` gives the form without it (the hit is then capture group 1).
"""

from __future__ import annotations

from lurewatch.rules import dims

ADDRESS = r"<\s*([^<>@\s]+@[^<>\s]+?)\s*>|(\b[^<>@\s,;]+@[^<>\s,;]+\b)"
DISPLAY = r'^\s*"?([^"<]*?)"?\s*<'
MAIL_ADDRESS = r"[\w.+-]+@[\w.-]+\.\w+"
HEADER_DOMAIN = r"[\w.+-]+@([\w.-]+)"
HTML_TAG = r"<[^>]+>"

URL = r"""(?i)\b(?:(?:https?|ftp)://|www\d{0,3}\.)[^\s<>"'`\]\)]+"""
ANCHOR = r"""(?is)<a\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)["']?[^>]*>(.*?)</a>"""
URL_TRAILING = r"""[.,;:!?)"'>]+$"""
URL_PARTS = r"^([^:]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
CREDENTIAL_PATH = (
    r"(?i)/(?:login|log-?in|signin|sign-?in|auth|verify|verification|validate|account|accounts|secure|security|update|"
    r"confirm|recover|reset|password|webmail|owa|portal|session|billing|unlock|myaccount)\b"
)
PERCENT_ESCAPE = r"%[0-9a-fA-F]{2}"
IP_HOST = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"

PHONE_BODY = (
    r"\+\d{1,3}[\s.\-]?\(?\d{1,4}\)?[\s.\-]?\d{3,4}[\s.\-]?\d{3,4}(?:[\s.\-]?\d{2,4})?"
    r"|\(?\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}"
    r"|\b1[\s.\-]8(?:00|33|44|55|66|77|88)[\s.\-]\d{3}[\s.\-]?\d{4}"
    r"|\b8(?:00|33|44|55|66|77|88)[\s.\-]\d{3}[\s.\-]\d{4}"
)
PHONE = r"(?<![\w.])(?:" + PHONE_BODY + r")(?![\w.])"
PHONE_PLAIN = r"(?:^|[^\w.])(" + PHONE_BODY + r")(?:$|[^\w.])"
CALL_TO_ACTION = (
    r"(?i)\b(?:call|dial|phone|contact|reach|speak (?:to|with)|talk to|ring)\b[^.!?\n]{0,60}"
    r"(?:\b(?:us|our|support|helpline|help ?desk|toll[- ]?free|customer (?:care|service|support)|representative|agent|"
    r"billing|refund)\b|[\+\(\d])"
    r"|\b(?:toll[- ]?free|helpline|customer care number|support number|contact number)\b"
)
BILLING_PRETEXT = (
    r"(?i)\b(?:auto[- ]?renew(?:al|ed|s)?|subscription (?:renew|charge|fee|expir)"
    r"|your (?:order|plan|membership|subscription) (?:has been|was|is) (?:renewed|charged|activated|confirmed)"
    r"|(?:debited|charged) (?:from )?your (?:account|card)"
    r"|to (?:cancel|stop|decline) (?:this|the|your) (?:order|subscription|renewal|charge|transaction)"
    r"|if you (?:did ?n[o']t|do not) (?:authori[sz]e|recognise|recognize|want)"
    r"|refund (?:department|team|request|process)|cancellation (?:department|request|fee))"
)

BODY_FROM_HEAD = (
    r"(?im)(?:^|[*_]|\n)\s*\*?(?:from|e-?mail|sender|sent by|reply[- ]to)\*?\s*[:：]\s*\*?([^\n]{0,120}?)"
)
BODY_FROM = BODY_FROM_HEAD + r"(?=\*(?:from|e-?mail|subject|sender)\b|\n|$)"
BODY_FROM_PLAIN = BODY_FROM_HEAD + r"(?:\*(?:from|e-?mail|subject|sender)\b|\n|$)"
CLAIMED_ADDRESS = r"[\w.+-]+@[\w.-]+\.\w{2,}"
BRACKET_CTA = r"\*?\[([^\]\n]{4,60})\]\*?"

ZERO_WIDTH = r"[\x{200B}-\x{200F}\x{FEFF}\x{2060}\x{180E}]"
CONFUSABLE = (
    r"\x{370}-\x{3FF}\x{1F00}-\x{1FFF}\x{400}-\x{52F}\x{1C80}-\x{1C8F}\x{A640}-\x{A69F}\x{531}-\x{58F}"
    r"\x{13A0}-\x{13FF}\x{AB70}-\x{ABBF}"
)
NON_ASCII_DROP = r"[\x00-\x7F]+"
HIDDEN_STYLE = (
    r"(?i)(?:font-size\s*:\s*0(?:\.0*)?(?:px|pt|em)?\b|display\s*:\s*none|visibility\s*:\s*hidden|"
    r"opacity\s*:\s*0(?:\.0*)?\b|color\s*:\s*#?(?:fff(?:fff)?|white)\b)"
)
THREAD_MARKER = (
    r"(?im)^\s*(?:-{2,}\s*original message\s*-{2,}|on [^\n]{0,60}wrote:|from:[^\n]*\n(?:sent|date):|>{1,}\s)"
)
REPLY_SUBJECT = r"(?i)^\s*(?:re|fw|fwd)\s*:"
LEET_PLAIN = r"(?i)\b[a-z]*[0134578@$]{1,}[a-z]+\b"
LEET = r"(?i)\b[a-z]*+[0134578@$]{1,}+[a-z]++\b"
REPEAT_RUN = r"(.)\1{3,}"
INTRAWORD_PUNCT_PLAIN = r"(?i)\b[a-z]{1,}['\-\.\|_]+[a-z]{1,}\b"
INTRAWORD_PUNCT = r"(?i)\b[a-z]{1,}+['\-\.\|_]++[a-z]{1,}+\b"
SPACED_LETTERS = r"(?i)(?:\b[a-z]\s){3,}[a-z]\b"
CURRENCY = (
    r"(?i)(?:[$£€₹]\s?[\d,]+(?:\.\d+)?(?:\s?(?:k|m|million|billion|bn))?|\b[\d,]+(?:\.\d+)?\s?[$£€₹]|"
    r"\b\d[\d,]*(?:\.\d+)?\s?(?:usd|eur|gbp|inr|dollars|pounds|euros|rupees)\b)"
)
# cheap necessary conditions of the two patterns above
LEET_GUARD = "[0134578@$][A-Za-z]"
CURRENCY_GUARD = r"[$£€₹]|[0-9,]\s?(?i:usd|eur|gbp|inr|dollars|pounds|euros|rupees)"
# Look-ahead tests of the first character, put before a pattern: most places are passed over at one glance.
URL_START = "(?=[HhFfWw])"
PHONE_START = r"(?=[+(\d])"
CURRENCY_START = r"(?=[$£€₹\d,])"
CONFUSABLE_START = r"(?=[^\x00-\x{36F}])"
LINK_TEXT = r"https?://\S+"


def _ext_union(exts) -> str:
    return "|".join(sorted(exts))


_BODY_EXT = _ext_union((set(dims.DANGEROUS_EXT) | set(dims.ARCHIVE_EXT)) - {"com"})
FILENAME_BODY = r"[\w\-]{1,50}(?:\.[\w\-]{1,8}){0,2}\.(?:" + _BODY_EXT + r")"
FILENAME = r"(?i)(?<![\w.@/])" + FILENAME_BODY + r"\b(?![\w.-])"
FILENAME_PLAIN = r"(?i)(?:^|[^\w.@/])(" + FILENAME_BODY + r")(?:$|[^\w.-])"
DOUBLE_EXT_BODY = r"[\w\-]{1,50}\.(?:" + "|".join(dims.DOCUMENT_EXT) + r")\.(?:" + _ext_union(dims.DANGEROUS_EXT) + r")"
DOUBLE_EXT = r"(?i)(?<![\w.@/])" + DOUBLE_EXT_BODY + r"\b(?![\w.-])"
DOUBLE_EXT_PLAIN = r"(?i)(?:^|[^\w.@/])(" + DOUBLE_EXT_BODY + r")(?:$|[^\w.-])"

# what a text with such a name must hold
FILENAME_GUARD = r"(?i)\.(?:" + _BODY_EXT + ")"
DOUBLE_EXT_GUARD = r"(?i)\.(?:" + "|".join(dims.DOCUMENT_EXT) + r")\.(?:" + _ext_union(dims.DANGEROUS_EXT) + ")"

DKIM_I = r"(?i)dkim=pass[^;]*?header\.i=@?([\w.-]+)"
DKIM_D = r"(?i)dkim=pass[^;]*?header\.d=([\w.-]+)"
SPF = r"(?i)spf=pass[^;]*?(?:smtp\.mailfrom|envelope-from)=@?([\w.-]+)"
AUTH_FAILED = r"(?i)spf=fail|spf=softfail|dkim=fail|dmarc=fail"

QUOTE_INTRO = (
    r"(?im)^\s*(?:on\s+[^\n]{4,80}?\s+wrote\s*:|-{2,}\s*original message\s*-{2,}|-{2,}\s*forwarded message\s*-{2,}"
    r"|\s*from\s*:\s*[^\n]{3,80}\n\s*(?:sent|date)\s*:)"
)
QUOTED_LINE = r"(?m)^\s*>+\s?([^\n]*)$"
MESSAGE_ID = r"<([^<>@\s]+@[^<>\s]+)>"
WORD_TOKEN = r"[a-z0-9']+"

STYLE_TOKEN = r"[a-z']+"
STYLE_QUOTED_LINE = r"(?m)^\s*>[^\n]*$"
STYLE_QUOTE_INTRO = (
    r"(?im)^\s*(?:on\s+[^\n]{4,80}?\s+wrote\s*:|-{2,}\s*(?:original|forwarded)\s+message\s*-{2,}"
    r"|from\s*:\s*[^\n]{3,80}$)"
)
STYLE_SIGNATURE = r"(?m)^\s*(?:--\s*$|__+\s*$)"
STYLE_URL = r"https?://\S+|www\.\S+"
STYLE_EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"

QUOTED_SECRET = r"""(?i)(?:password|passcode|pwd)\s*(?:is|:|was)\s*["'“]?([^\s"'”,.<>]{6,40})"""

# Flags on lower-cased subject + ' ' + body.
TEXT_FLAGS = {
    "pat_gift_card_ask": (
        r"\b(?:purchase|buy|get|pick up|obtain|send|need)\b[^.!?\n]{0,40}\bgift ?cards?\b"
        r"|\bgift ?cards?\b[^.!?\n]{0,30}\b(?:for a client|urgently|asap|right away|and send|codes?|scratch)\b"
    ),
    "pat_money_ask": (
        r"\b(?:send|wire|transfer|lend|loan|remit|spare)\s+(?:me|us)\b[^.!?\n]{0,30}\b(?:money|cash|funds?|amount|\d)"
        r"|\bkindly\s+(?:send|transfer|remit)\b|\brequest(?:ing)?\s+(?:for\s+)?(?:an?\s+)?(?:sum|amount|loan|\d)"
        r"|\b(?:need|require)\s+(?:some\s+)?(?:money|cash|financial (?:help|assistance))\b"
        r"|\bhelp me (?:out )?with\s+(?:some\s+)?(?:money|cash|[$£€₹])"
    ),
    "pat_archive_password": (
        r"password (?:for|to|is)[^.!?\n]{0,40}(?:archive|attach|file|document|zip)"
        r"|(?:archive|attachment|file|zip)[^.!?\n]{0,30}password is"
    ),
    "pat_macro": r"enable editing|enable content|enable macro",
    "pat_macro_or_view": r"enable editing|enable content|enable macro|protected view",
    "pat_bank_changed": (
        r"bank details have changed|change of bank|updated bank|new account details|update my direct deposit|"
        r"direct deposit details|changed banks"
    ),
    "pat_bank_words": (
        r"bank details|banking details|account details|change of bank|updated bank|new account details|"
        r"payment details have changed"
    ),
    "pat_remote_tool": r"\b(?:anydesk|teamviewer|ultraviewer|screenconnect|logmein)\b",
    "pat_qr": r"qr code|scan the qr|scan the code",
    "pat_invoice": (
        r"invoice|purchase order|remittance|statement of account|receipt|billing statement|proforma"
    ),
    "pat_supplier": r"supplier|vendor|account manager|our records|your account with us|contract no",
    "pat_inheritance": (
        r"next of kin|late husband|deceased client|barrister|unclaimed estate|my late father|consignment box"
    ),
    "pat_gift_card_words": r"gift card",
    "pat_payroll": r"direct deposit|payroll|salary account",
    "pat_new_bank": (
        r"changed banks|change my bank|update my direct deposit|new bank|different bank|update my account|"
        r"new routing number|new account number"
    ),
    "pat_password_word": r"password",
    "pat_job_fee": (
        r"\b(?:registration|security|training|processing|activation|onboarding|start[- ]?up|joining|clearance|"
        r"placement)\s+fees?\b"
    ),
    "pat_messenger": r"\b(?:what ?s ?app|telegram)\b",
    "pat_opener": (
        r"are you available|are you at your desk|quick favour|quick favor|do you have a moment|can you assist|"
        r"let me know if you get this|are you in the office|i need a favour|i need a favor|kindly confirm receipt"
    ),
}
OFFICIAL_DISPLAY = (
    r"(?i)\b(?:support|security|service|services|team|account|accounts|notification|no-?reply|alert|admin|"
    r"administrator|helpdesk|help desk|billing|customer care)\b"
)

# Recipient exposure areas, matched on subject + ' ' + body.
EXPOSURE = {
    "finance": (
        r"(?i)\b(?:invoice|remittance|purchase order|payment (?:received|confirmation|due|request)|accounts payable|"
        r"wire transfer|bank details|statement of account|payroll|reimbursement|expense report|receipt for)\b"
    ),
    "credentials": (
        r"(?i)\b(?:password (?:reset|changed|expires)|verification code|one-?time (?:code|password)|two-?factor|"
        r"authenticator|sign-?in (?:alert|attempt)|security alert|account recovery|api key|access token|"
        r"admin(?:istrator)? (?:access|console))\b"
    ),
    "vendor": (
        r"(?i)\b(?:supplier|vendor|contract (?:renewal|signature)|procurement|quotation|tender|service agreement|"
        r"sow\b|statement of work)\b"
    ),
    "hr": (
        r"(?i)\b(?:offer letter|onboarding|employee|benefits enrol|leave request|performance review|resignation|"
        r"new starter)\b"
    ),
    "executive": (
        r"(?i)\b(?:board (?:meeting|pack|deck)|shareholder|acquisition|due diligence|quarterly results|investor)\b"
    ),
}

LIST_SUBJECT = r"(?i)^\s*(?:(?:re|fw|fwd)\s*:\s*)*\[[\w .+-]{2,24}\]"
LIST_TRAFFIC = (
    r"(?i)(\[[\w.-]+-(?:checkins|commits|dev|users|announce|list)\]|svn commit|revision:\s*\d+|modified paths"
    r"|diff --git|\+\+\+ |--- trunk|cvs commit|unsubscribe from this list|list-unsubscribe|mailman/listinfo|majordomo"
    r"|/mailman/|to unsubscribe,? (?:e-?mail|send)|\bdigest\b[^\n]{0,20}\bvol\b|reply-to:\s*<?[\w.-]+-list)"
)
