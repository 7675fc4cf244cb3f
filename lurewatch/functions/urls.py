"""Links of a message as one array of facts per row: no explode, no shuffle, rows without links survive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.common import collapse, extract_all, fence, flag, member, ratio, sql_string
from lurewatch.functions.sender import owner_of, registrable
from lurewatch.rules import dims, patterns as P

FLAGS = ("userinfo", "ip_literal", "shortener", "punycode", "high_risk_tld", "credential_path", "hex_encoding",
         "deep_subdomain", "brand_mismatch", "dangerous_ext", "archive_ext", "anchor_mismatch")


def candidates(text: Column, html: Column) -> Column:
    """Plain-text links, then anchors in first-seen order (the last text of an href wins), de-duplicated on the
    lower-cased spelling with the first spelling kept."""
    plain = F.transform(extract_all(text, P.URL_START + P.URL), lambda u: F.struct(
        u.alias("raw"), F.lit(None).cast("string").alias("anchor_text")))
    pairs = F.transform(
        F.arrays_zip(extract_all(html, P.ANCHOR, 1).alias("h"), extract_all(html, P.ANCHOR, 2).alias("t")),
        lambda z: F.struct(F.trim(z["h"]).alias("raw"),
                           collapse(F.regexp_replace(z["t"], P.HTML_TAG, " ")).alias("anchor_text")))
    hrefs = F.array_distinct(F.transform(pairs, lambda z: z.raw))
    anchors = F.transform(hrefs, lambda h: F.element_at(F.filter(pairs, lambda z: z.raw == h), -1))
    both = F.concat(plain, F.coalesce(F.when(html.contains("<"), anchors), F.array().cast(
        "array<struct<raw:string,anchor_text:string>>")))
    return F.filter(
        F.transform(both, lambda x: F.struct(
            F.regexp_replace(x.raw, P.URL_TRAILING, "").alias("raw"), x.anchor_text.alias("anchor_text"))),
        lambda x: x.raw != "")


def keep_first(cands: Column) -> Column:
    keys = F.transform(cands, lambda x: F.lower(x.raw))
    return F.filter(cands, lambda x, i: F.array_position(keys, F.lower(x.raw)) == i + 1)


def split_parts(cands: Column) -> Column:
    def parts(x):
        norm = F.when(x.raw.contains("://"), x.raw).otherwise(F.concat(F.lit("http://"), x.raw))
        netloc = F.regexp_extract(norm, P.URL_PARTS, 2)
        query = F.regexp_extract(norm, P.URL_PARTS, 4)
        return F.struct(
            x.raw.alias("raw"), x.anchor_text.alias("anchor_text"),
            F.lower(F.regexp_extract(norm, P.URL_PARTS, 1)).alias("scheme"),
            F.lower(F.substring_index(F.substring_index(netloc, "@", -1), ":", 1)).alias("host"),
            netloc.rlike("^.+@").alias("userinfo"),
            F.concat(F.regexp_extract(norm, P.URL_PARTS, 3), F.when(query == "?", F.lit("")).otherwise(query)).alias("path"),
        )
    return F.transform(cands, parts)


def add_domains(parts: Column) -> Column:
    def more(x):
        hay = F.concat(x.host, x.path)
        decoded = F.when(hay.contains("%"), F.coalesce(
            F.try_url_decode(F.replace(hay, F.lit("+"), F.lit("%2B"))), hay)).otherwise(hay)
        ext = F.lower(F.substring_index(F.regexp_extract(x.path, r"\.([^.]*)$", 1), "?", 1))
        reg = registrable(x.host)
        shown = F.regexp_replace(F.lower(F.trim(x.anchor_text)), "/+$", "")
        return F.struct(
            x.raw.alias("raw"), x.anchor_text.alias("anchor_text"), x.scheme.alias("scheme"), x.host.alias("host"),
            x.userinfo.alias("userinfo"), x.path.alias("path"), reg.alias("registrable"),
            owner_of(reg).alias("owner"), F.substring_index(reg, ".", 1).alias("base"),
            F.when(reg.contains("."), F.substring_index(reg, ".", -1)).otherwise(F.lit("")).alias("tld"),
            F.lower(decoded).alias("hay"), ext.alias("ext"), shown.alias("shown"),
            registrable(F.substring_index(F.regexp_replace(shown, "https?://", ""), "/", 1)).alias("shown_registrable"),
        )
    return F.transform(parts, more)


def add_flags(urls: str) -> Column:
    """The twelve flags of each link, written as one SQL lambda over the staged facts."""
    def member_sql(c, values):
        return f"array_contains(array({', '.join(sql_string(v) for v in values)}), {c})"

    tokens = ", ".join(
        f"named_struct('token', {sql_string(t)}, 'brand', {sql_string(b)}, 'base', {sql_string(b.replace(' ', ''))})"
        for t, b in dims.brand_tokens() if len(t) >= 4)
    return F.expr(f"""
      transform({urls}, x -> named_struct(
        'raw', x.raw, 'anchor_text', x.anchor_text, 'scheme', x.scheme, 'host', x.host, 'path', x.path,
        'registrable', x.registrable, 'tld', x.tld, 'ext', x.ext, 'userinfo', x.userinfo,
        'ip_literal', x.host RLIKE {sql_string(P.IP_HOST)},
        'shortener', {member_sql('x.registrable', dims.SHORTENERS)},
        'punycode', contains(x.host, 'xn--'),
        'high_risk_tld', {member_sql('x.tld', dims.HIGH_RISK_TLDS)},
        'credential_path', x.path RLIKE {sql_string(P.CREDENTIAL_PATH)},
        'hex_encoding', regexp_count(x.raw, {sql_string(P.PERCENT_ESCAPE)}) >= 4,
        'deep_subdomain', length(x.host) - length(replace(x.host, '.', '')) >= 4,
        'brand_mismatch', exists(array({tokens}), t -> contains(x.hay, t.token) AND NOT (
            coalesce(t.brand = x.owner, false) OR (x.base <> '' AND t.base = x.base))),
        'dangerous_ext', {member_sql('x.ext', dims.DANGEROUS_EXT)},
        'archive_ext', NOT {member_sql('x.ext', dims.DANGEROUS_EXT)} AND {member_sql('x.ext', dims.ARCHIVE_EXT)},
        'anchor_mismatch', coalesce(contains(x.shown, '.') AND NOT contains(x.shown, ' ') AND x.shown <> x.host
            AND contains(x.shown_registrable, '.') AND x.shown_registrable <> x.registrable, false)))""")


def with_urls(df: DataFrame, text: str = "body_text", html: str = "body") -> DataFrame:
    """Add `urls`: array of link facts with twelve boolean flags. Each step is its own projection, so no step is
    evaluated twice."""
    df = (
        df.withColumn("urls", candidates(F.col(text), F.coalesce(F.col(html), F.lit(""))))
        .withColumn("urls", keep_first(F.col("urls")))
        .withColumn("urls", split_parts(F.col("urls")))
        .withColumn("urls", add_domains(F.col("urls")))
        .withColumn("urls", add_flags("urls"))
    )
    return fence(df, "urls")


def url_features() -> dict[str, Column]:
    """The 19 link features of a row with `urls`."""
    urls = F.col("urls")
    n = F.size(urls)

    def has(name):
        return flag(F.exists(urls, lambda u: u[name]))

    def total(value):
        return F.aggregate(urls, F.lit(0), lambda acc, u: acc + value(u))

    n_flags = total(lambda u: sum((u[f].cast("int") for f in FLAGS[1:]), u[FLAGS[0]].cast("int")))
    domains = F.array_distinct(F.filter(F.transform(urls, lambda u: u.registrable), lambda d: d != ""))
    return {
        "url_count": n.cast("double"),
        "url_unique_domains": F.size(domains).cast("double"),
        "url_has_ip_literal": has("ip_literal"),
        "url_has_shortener": has("shortener"),
        "url_has_punycode": has("punycode"),
        "url_has_userinfo": has("userinfo"),
        "url_has_credential_path": has("credential_path"),
        "url_has_high_risk_tld": has("high_risk_tld"),
        "url_has_brand_mismatch": has("brand_mismatch"),
        "url_has_anchor_mismatch": has("anchor_mismatch"),
        "url_has_dangerous_ext": has("dangerous_ext"),
        "url_has_archive_ext": has("archive_ext"),
        "url_has_hex_encoding": has("hex_encoding"),
        "url_deep_subdomain": has("deep_subdomain"),
        "url_max_len": F.coalesce(F.array_max(F.transform(urls, lambda u: F.length(u.raw))), F.lit(0)).cast("double"),
        "url_mean_len": ratio(total(lambda u: F.length(u.raw)), n),
        "url_https_ratio": ratio(total(lambda u: (u.scheme == "https").cast("int")), n),
        "url_flag_density": ratio(n_flags, n),
        "url_legit_domain_ratio": ratio(
            total(lambda u: member(u.registrable, dims.LEGIT_DOMAINS).cast("int")), n),
    }


def hard_executable_link(allow_sender: Column, allow_link) -> Column:
    """A link path ends in a directly executable type; allowlisted senders and link domains are left out."""
    hit = F.exists(F.col("urls"), lambda u: member(u.ext, dims.HARD_EXECUTABLE_EXT) & u.path.contains(".")
                   & ~allow_link(u.registrable))
    return ~allow_sender & hit
