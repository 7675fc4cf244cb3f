"""Who the message says it is from, and whether name and domain agree."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.common import flag, kept_length, member, ratio, sql_string, string_map, strings
from lurewatch.rules import dims, patterns as P

REGISTRABLE = r"((?:[^.]+\.(?:" + "|".join(dims.SUFFIX_LABELS) + r")\.[^.]{2})|[^.]+\.[^.]+|[^.]+)$"
LOOKALIKE_TARGETS = tuple(d for d in dims.LEGIT_DOMAINS if len(d) >= 8)
ANY_TOKEN = r"\b(?:" + "|".join(re.escape(t) for t, _ in dims.brand_tokens()) + r")\b"


def registrable(host: Column) -> Column:
    """eTLD+1 by rule: two labels, three under a generic second level with a two-letter TLD."""
    h = F.regexp_replace(F.lower(host), r"\.{2,}", ".")
    return F.regexp_extract(F.btrim(h, F.lit(".")), REGISTRABLE, 1)


def address_of(raw: Column) -> Column:
    bracketed = F.regexp_extract(raw, P.ADDRESS, 1)
    return F.lower(F.when(bracketed != "", bracketed).otherwise(F.regexp_extract(raw, P.ADDRESS, 2)))


def domain_of(address: Column) -> Column:
    return F.when(address.contains("@"), F.substring_index(address, "@", -1)).otherwise(F.lit(""))


def entropy(s: Column) -> Column:
    """Shannon entropy of the characters of s, in bits."""
    n = F.length(s)
    chars = F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))

    def add(acc, ch):
        p = (n - F.length(F.replace(s, ch, F.lit("")))) / n
        return acc - p * F.log2(p)

    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(chars, F.lit(0.0), add))


def _tokens() -> Column:
    return F.expr("array(" + ", ".join(
        f"named_struct('token', {sql_string(t)}, 'brand', {sql_string(b)})" for t, b in dims.brand_tokens()) + ")")


def owner_of(domain: Column) -> Column:
    return F.element_at(string_map(dims.DOMAIN_OWNER.items()), domain)


def owns(brand: Column, domain: Column) -> Column:
    """A brand owns its listed domains and any `<brand>.<suffix>`."""
    base = F.substring_index(domain, ".", 1)
    return (domain != "") & (
        F.coalesce(owner_of(domain) == brand, F.lit(False)) | (base == F.replace(brand, F.lit(" "), F.lit("")))
    )


def claimed_brand(display: Column) -> Column:
    """First brand token (in list order) that stands as a word in the display name."""
    name = F.regexp_replace(F.lower(display), "[^a-z0-9 ]", "")
    padded = F.concat(F.lit(" "), name, F.lit(" "))
    first = F.get(F.filter(_tokens(), lambda t: padded.contains(F.concat(F.lit(" "), t.token, F.lit(" ")))), F.lit(0))
    return F.when(name.rlike(ANY_TOKEN), first.brand)


def lookalike(domain: Column) -> Column:
    """struct(distance, domain) of the nearest well-known domain at edit distance 1 or 2, else NULL."""
    near = F.filter(strings(LOOKALIKE_TARGETS), lambda d: F.abs(F.length(d) - F.length(domain)) <= 2)
    scored = F.transform(near, lambda d: F.struct(F.levenshtein(domain, d, 2).alias("distance"), d.alias("domain")))
    best = F.array_min(F.filter(scored, lambda s: s.distance > 0))
    return F.when((F.length(domain) >= 8) & ~member(domain, dims.LEGIT_DOMAINS), best)


def with_sender(df: DataFrame) -> DataFrame:
    """Add address, display_name, local_part, domain, registrable, tld and the brand and lookalike facts."""
    raw = F.trim(F.coalesce(F.col("sender"), F.lit("")))
    df = df.withColumn("address", address_of(raw)).withColumn(
        "display_name",
        F.when(raw.rlike(P.DISPLAY), F.trim(F.regexp_extract(raw, P.DISPLAY, 1)))
        .when(F.col("address") == "", raw)
        .otherwise(F.lit("")),
    )
    df = df.withColumn("domain", domain_of(F.col("address"))).withColumn("registrable", registrable(F.col("domain")))
    addr, reg = F.col("address"), F.col("registrable")
    df = df.withColumns({
        "local_part": F.when(addr.contains("@"), F.left(addr, F.length(addr) - F.length("domain") - F.lit(1)))
        .otherwise(F.lit("")),
        "tld": F.when(reg.contains("."), F.substring_index(reg, ".", -1)).otherwise(F.lit("")),
        "is_freemail": member(reg, dims.FREEMAIL),
        "claimed_brand": claimed_brand(F.col("display_name")),
        "near": lookalike(reg),
    })
    return df.withColumns({
        "brand_mismatch": F.coalesce(
            F.col("claimed_brand").isNotNull() & (reg != "") & ~owns(F.col("claimed_brand"), reg), F.lit(False)),
        "lookalike_of": F.col("near.domain"),
        "lookalike_distance": F.coalesce(F.col("near.distance"), F.lit(0)),
    }).drop("near")


def header_features() -> dict[str, Column]:
    """The 17 header features; needs the columns of `with_sender`."""
    reg, local, dom = F.col("registrable"), F.col("local_part"), F.col("domain")
    recv = F.lower(F.trim(F.coalesce(F.col("receiver"), F.lit(""))))
    recipients = F.size(F.filter(F.split(recv, "[,;]"), lambda r: r.contains("@")))

    def dots(c):
        return F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))

    return {
        "hdr_sender_present": flag(F.col("address") != ""),
        "hdr_display_name_present": flag(F.col("display_name") != ""),
        "hdr_brand_display_mismatch": flag(F.col("brand_mismatch")),
        "hdr_domain_is_lookalike": flag(F.col("lookalike_of").isNotNull()),
        "hdr_sender_freemail": flag(F.col("is_freemail")),
        "hdr_sender_tld_high_risk": flag(member(F.col("tld"), dims.HIGH_RISK_TLDS)),
        "hdr_sender_domain_digits": kept_length(reg, "[^0-9]+").cast("double"),
        "hdr_sender_domain_len": F.length(reg).cast("double"),
        "hdr_sender_subdomain_depth": F.greatest(F.lit(0), dots(dom) - dots(reg)).cast("double"),
        "hdr_sender_local_entropy": entropy(local),
        "hdr_sender_local_len": F.length(local).cast("double"),
        "hdr_sender_local_digit_ratio": ratio(kept_length(local, "[^0-9]+"), F.length(local)),
        "hdr_recipient_count": recipients.cast("double"),
        "hdr_recipient_missing": flag(recipients == 0),
        "hdr_recipient_undisclosed": flag(recv.contains("undisclosed") | recv.contains("recipients")),
        "hdr_same_domain_as_recipient": flag((reg != "") & (recv != "") & recv.contains(reg)),
        "hdr_date_missing": flag(F.col("sent_at").isNull()),
    }


def auth_aligned(auth: Column, domain: Column) -> Column:
    """True when a DKIM or SPF pass names a domain with the same registrable domain as From."""
    hit = F.lit(False)
    for pat in (P.DKIM_I, P.DKIM_D, P.SPF):
        signed = F.regexp_extract_all(auth, F.lit(pat), F.lit(1))
        hit = hit | F.exists(signed, lambda d: registrable(d) == domain)
    return F.coalesce((auth != "") & (domain != "") & hit, F.lit(False))


def header_domain(raw: Column) -> Column:
    """Registrable domain of the first address in a header such as Reply-To."""
    return registrable(F.regexp_extract(F.lower(raw), P.HEADER_DOMAIN, 1))
