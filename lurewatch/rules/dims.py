"""Reference dimensions.

Fixed values: the lists below must hold exactly these entries for the flags built on them to be right.
"""

from __future__ import annotations

# brand -> registrable domains the brand sends from
BRAND_DOMAINS = {
    "paypal": ("paypal.com", "paypal.co.uk"),
    "microsoft": ("microsoft.com", "office.com", "office365.com", "live.com", "outlook.com", "microsoftonline.com",
                  "sharepoint.com", "msn.com", "windows.com", "azure.com", "msdn.com", "microsoftstore.com",
                  "skype.com", "github.com"),
    "apple": ("apple.com", "icloud.com", "itunes.com", "me.com", "mac.com"),
    "amazon": ("amazon.com", "amazon.co.uk", "amazonses.com", "amazonaws.com", "awsstatic.com", "audible.com"),
    "google": ("google.com", "gmail.com", "googlemail.com", "youtube.com", "googlecode.com", "googleapis.com",
               "googleusercontent.com", "gstatic.com", "googlesyndicatedsearch.com", "googlesource.com",
               "googleblog.com", "goo.gl", "withgoogle.com", "android.com"),
    "netflix": ("netflix.com",),
    "linkedin": ("linkedin.com",),
    "dropbox": ("dropbox.com", "dropboxmail.com"),
    "docusign": ("docusign.com", "docusign.net"),
    "adobe": ("adobe.com", "adobesign.com"),
    "fedex": ("fedex.com",),
    "dhl": ("dhl.com", "dhl.de"),
    "ups": ("ups.com",),
    "chase": ("chase.com", "jpmorgan.com"),
    "wells fargo": ("wellsfargo.com",),
    "citibank": ("citi.com", "citibank.com"),
    "bank of america": ("bankofamerica.com", "bofa.com"),
    "hsbc": ("hsbc.com", "hsbc.co.uk"),
    "barclays": ("barclays.com", "barclays.co.uk"),
    "natwest": ("natwest.com",),
    "american express": ("americanexpress.com", "aexp.com"),
    "stripe": ("stripe.com",),
    "coinbase": ("coinbase.com",),
    "binance": ("binance.com",),
    "hmrc": ("hmrc.gov.uk", "gov.uk"),
    "irs": ("irs.gov",),
    "facebook": ("facebook.com", "fb.com", "meta.com"),
    "instagram": ("instagram.com",),
    "whatsapp": ("whatsapp.com",),
    "zoom": ("zoom.us", "zoom.com"),
    "slack": ("slack.com",),
    "salesforce": ("salesforce.com",),
    "intuit": ("intuit.com", "quickbooks.com"),
    "ebay": ("ebay.com", "ebay.co.uk"),
    "walmart": ("walmart.com",),
    "usps": ("usps.com", "usps.gov"),
}

# other words that name a brand
BRAND_ALIASES = {
    "office365": "microsoft", "o365": "microsoft", "onedrive": "microsoft", "sharepoint": "microsoft",
    "outlook": "microsoft", "msft": "microsoft", "icloud": "apple", "itunes": "apple", "aws": "amazon",
    "prime": "amazon", "bofa": "bank of america", "amex": "american express", "jpmorgan": "chase",
}

FREEMAIL = (
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.uk", "yahoo.co.jp", "hotmail.com", "hotmail.co.uk",
    "outlook.com", "live.com", "msn.com", "aol.com", "mail.com", "gmx.com", "gmx.net", "gmx.de", "yandex.ru",
    "yandex.com", "mail.ru", "protonmail.com", "proton.me", "tutanota.com", "zoho.com", "icloud.com", "me.com",
    "inbox.com", "rediffmail.com", "163.com", "126.com", "qq.com", "sina.com", "web.de", "t-online.de",
    "libero.it", "free.fr", "orange.fr", "wanadoo.fr", "terra.com", "maktoob.com", "rocketmail.com", "ymail.com",
    "fastmail.com",
)

HIGH_RISK_TLDS = (
    "tk", "ml", "ga", "cf", "gq", "top", "xyz", "work", "click", "link", "country", "stream", "download", "racing",
    "win", "bid", "loan", "date", "review", "faith", "science", "party", "trade", "webcam", "accountant", "cricket",
    "gdn", "men", "kim", "mom", "zip", "mov", "rest", "cyou", "sbs", "quest", "monster", "buzz", "icu", "cam",
    "surf", "lol", "autos",
)

SHORTENERS = (
    "bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "is.gd", "buff.ly", "adf.ly", "bit.do", "cutt.ly", "rb.gy",
    "shorturl.at", "tiny.cc", "rebrand.ly", "s.id", "t.ly", "shorte.st", "bl.ink", "lnkd.in", "db.tt", "qr.ae",
    "j.mp", "tr.im", "soo.gd", "clck.ru", "v.gd",
)

DANGEROUS_EXT = (
    "exe", "scr", "com", "pif", "bat", "cmd", "vbs", "vbe", "js", "jse", "wsf", "wsh", "hta", "msi", "msp", "cpl",
    "jar", "ps1", "psm1", "reg", "lnk", "iso", "img", "vhd", "vhdx", "cab", "dll", "scf", "inf", "application",
    "docm", "xlsm", "pptm", "dotm", "xlam", "xll", "xlsb", "slk", "iqy", "one", "svg", "chm", "appref-ms",
    "diagcab", "settingcontent-ms",
)

ARCHIVE_EXT = ("zip", "rar", "7z", "tar", "gz", "bz2", "arj", "ace", "z", "lzh")

HARD_EXECUTABLE_EXT = (
    "exe", "scr", "pif", "bat", "cmd", "vbs", "vbe", "jse", "wsf", "hta", "lnk", "iso", "img", "cpl", "scf", "msi",
    "docm", "xlsm", "pptm", "xll",
)

DOCUMENT_EXT = ("pdf", "doc", "docx", "xls", "xlsx", "jpg", "jpeg", "png", "txt", "rtf")

# second-level labels that act as public suffixes under a two-letter TLD
SUFFIX_LABELS = ("co", "com", "net", "org", "gov", "edu", "ac", "mil", "or", "ne", "go")

TOLL_FREE = ("800", "833", "844", "855", "866", "877", "888")

# link hosts used by everyone, on top of brand and shortener domains
COMMON_HOSTS_EXTRA = (
    "googleapis.com", "gstatic.com", "cloudfront.net", "akamaihd.net", "sendgrid.net", "mailchimp.com",
    "mailgun.org", "amazonses.com", "list-manage.com", "mcusercontent.com", "substack.com", "medium.com",
    "twitter.com", "x.com", "unsubscribe.com", "cdn.jsdelivr.net",
)

# first bytes (hex), file type, runs when opened; the first prefix that fits wins
MAGIC_BYTES = (
    ("4D5A", "windows-executable", True),
    ("7F454C46", "linux-executable", True),
    ("CAFEBABE", "macho-fat-binary", True),
    ("CFFAEDFE", "macho-executable", True),
    ("25504446", "pdf", False),
    ("504B0304", "zip-container", False),
    ("52617221", "rar-archive", False),
    ("D0CF11E0", "ole-compound", False),
    ("2321", "script", True),
    ("1F8B", "gzip", False),
)
# extension -> type the bytes should have
EXPECTED_TYPE = {
    "pdf": "pdf", "zip": "zip-container", "docx": "zip-container", "xlsx": "zip-container", "pptx": "zip-container",
    "doc": "ole-compound", "xls": "ole-compound",
}

LEGIT_DOMAINS = tuple(sorted({d for ds in BRAND_DOMAINS.values() for d in ds}))
DOMAIN_OWNER = {d: b for b, ds in BRAND_DOMAINS.items() for d in ds}


def brand_tokens() -> list[tuple[str, str]]:
    """(token, brand) in scan order: each brand's joined and spaced name, then the aliases."""
    seen: dict[str, str] = {}
    for brand in BRAND_DOMAINS:
        seen.setdefault(brand.replace(" ", ""), brand)
        seen.setdefault(brand, brand)
    seen.update(BRAND_ALIASES)
    return list(seen.items())


COMMON_HOSTS = tuple(sorted(set(LEGIT_DOMAINS) | set(SHORTENERS) | set(COMMON_HOSTS_EXTRA)))
