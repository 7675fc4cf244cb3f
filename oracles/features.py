"""Oracle CTEs of the feature row: links and brands are exploded here, where the Spark plan keeps arrays."""

from __future__ import annotations

import re

from lurewatch.functions.sender import REGISTRABLE
from lurewatch.functions.urls import FLAGS
from lurewatch.rules import dims, patterns as P
from lurewatch.rules.lexicons import compile_banks
from oracles.base import count, cte, flag, has, lst, rows, s

BANKS = compile_banks()


def reg(host: str) -> str:
    return f"regexp_extract(trim(regexp_replace(lower({host}), '\\.{{2,}}', '.', 'g'), '.'), {s(REGISTRABLE)}, 1)"


def kept(text: str, dropped: str) -> str:
    return f"CAST(length(regexp_replace({text}, {s(dropped)}, '', 'g')) AS DOUBLE)"


def fold(text: str) -> str:
    """Accented letters as plain ones: RE2's word boundary only knows ASCII, Java's knows all letters."""
    return f"regexp_replace({text}, '[\\x{{C0}}-\\x{{24F}}]', 'x', 'g')"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')"


def div(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN ({a}) / ({b}) ELSE 0.0::DOUBLE END"


cte("brand_token", (), rows("ord, token, brand", [(i, t, b) for i, (t, b) in enumerate(dims.brand_tokens())]))
cte("brand_domain", (), rows("domain, brand", dims.DOMAIN_OWNER.items()))

cte("base", ("messages",), f"""
SELECT *, '' AS return_path, regexp_replace(body, {s(P.HTML_TAG)}, ' ', 'g') AS body_text, trim(sender) AS raw_sender
FROM messages""")

cte("sender0", ("base",), f"""
SELECT *, {reg('domain')} AS registrable FROM (
  SELECT *, CASE WHEN contains(address, '@') THEN regexp_extract(address, '([^@]*)$', 1) ELSE '' END AS domain
  FROM (
    SELECT *, lower(CASE WHEN regexp_extract(raw_sender, {s(P.ADDRESS)}, 1) <> '' THEN regexp_extract(raw_sender, {s(P.ADDRESS)}, 1)
                         ELSE regexp_extract(raw_sender, {s(P.ADDRESS)}, 2) END) AS address FROM base))""")

cte("lookalikes", ("sender0", "brand_domain"), f"""
SELECT registrable, domain AS lookalike_of, distance FROM (
  SELECT r.registrable, b.domain, levenshtein(r.registrable, b.domain) AS distance,
         row_number() OVER (PARTITION BY r.registrable ORDER BY levenshtein(r.registrable, b.domain), b.domain) AS rn
  FROM (SELECT DISTINCT registrable FROM sender0) r
  JOIN brand_domain b ON length(b.domain) >= 8 AND abs(length(b.domain) - length(r.registrable)) <= 2
  WHERE length(r.registrable) >= 8 AND r.registrable NOT IN {lst(dims.LEGIT_DOMAINS)}
    AND levenshtein(r.registrable, b.domain) BETWEEN 1 AND 2)
WHERE rn = 1""")

cte("claims_brand", ("sender1", "brand_token"), """
SELECT m.message_id, arg_min(t.brand, t.ord) AS claimed_brand
FROM sender1 m JOIN brand_token t
  ON contains(' ' || regexp_replace(lower(m.display_name), '[^a-z0-9 ]', '', 'g') || ' ', ' ' || t.token || ' ')
GROUP BY m.message_id""")

cte("sender1", ("sender0",), f"""
SELECT *, CASE WHEN {has('raw_sender', P.DISPLAY)} THEN trim(regexp_extract(raw_sender, {s(P.DISPLAY)}, 1))
               WHEN address = '' THEN raw_sender ELSE '' END AS display_name,
       CASE WHEN contains(address, '@') THEN substr(address, 1, length(address) - length(domain) - 1) ELSE '' END AS local_part,
       CASE WHEN contains(registrable, '.') THEN regexp_extract(registrable, '([^.]*)$', 1) ELSE '' END AS tld
FROM sender0""")

cte("sender_facts", ("sender1", "claims_brand", "lookalikes", "brand_domain"), f"""
SELECT s.*, c.claimed_brand, l.lookalike_of, coalesce(l.distance, 0) AS lookalike_distance,
       s.registrable IN {lst(dims.FREEMAIL)} AS is_freemail,
       coalesce(c.claimed_brand IS NOT NULL AND s.registrable <> ''
         AND NOT (coalesce(d.brand = c.claimed_brand, false)
                  OR split_part(s.registrable, '.', 1) = replace(c.claimed_brand, ' ', '')), false) AS brand_mismatch
FROM sender1 s LEFT JOIN claims_brand c USING (message_id) LEFT JOIN lookalikes l USING (registrable)
LEFT JOIN brand_domain d ON d.domain = s.registrable""")

_R = "lower(trim(receiver))"
_NREC = f"len(list_filter(string_split_regex({_R}, '[,;]'), lambda r: contains(r, '@')))"


def dots(c: str) -> str:
    return f"(length({c}) - length(replace({c}, '.', '')))"


HEADER = {
    "hdr_sender_present": flag("address <> ''"),
    "hdr_display_name_present": flag("display_name <> ''"),
    "hdr_brand_display_mismatch": flag("brand_mismatch"),
    "hdr_domain_is_lookalike": flag("lookalike_of IS NOT NULL"),
    "hdr_sender_freemail": flag("is_freemail"),
    "hdr_sender_tld_high_risk": flag(f"tld IN {lst(dims.HIGH_RISK_TLDS)}"),
    "hdr_sender_domain_digits": kept("registrable", "[^0-9]+"),
    "hdr_sender_domain_len": "length(registrable)::DOUBLE",
    "hdr_sender_subdomain_depth": f"greatest(0, {dots('domain')} - {dots('registrable')})::DOUBLE",
    "hdr_sender_local_entropy": "CASE WHEN local_part = '' THEN 0.0 ELSE entropy_of_local END",
    "hdr_sender_local_len": "length(local_part)::DOUBLE",
    "hdr_sender_local_digit_ratio": div(kept("local_part", "[^0-9]+"), "length(local_part)"),
    "hdr_recipient_count": f"{_NREC}::DOUBLE",
    "hdr_recipient_missing": flag(f"{_NREC} = 0"),
    "hdr_recipient_undisclosed": flag(f"contains({_R}, 'undisclosed') OR contains({_R}, 'recipients')"),
    "hdr_same_domain_as_recipient": flag(f"registrable <> '' AND {_R} <> '' AND contains({_R}, registrable)"),
    "hdr_date_missing": flag("sent_at IS NULL"),
}
cte("local_entropy", ("sender1",), """
SELECT local_part, -sum((n / t) * log2(n / t)) AS entropy_of_local FROM (
  SELECT local_part, ch, count(*)::DOUBLE AS n, length(local_part)::DOUBLE AS t FROM (
    SELECT local_part, unnest(string_split(local_part, '')) AS ch FROM (SELECT DISTINCT local_part FROM sender1 WHERE local_part <> ''))
  WHERE ch <> '' GROUP BY ALL) GROUP BY local_part""")
cte("f_header", ("sender_facts", "local_entropy"), "SELECT message_id, " + ", ".join(
    f"{v} AS {k}" for k, v in HEADER.items()) + " FROM sender_facts LEFT JOIN local_entropy USING (local_part)")


def url_ctes(prefix: str, source: str, key: str, text: str, html: str) -> None:
    """Link facts for any relation with a key, a text and an html column."""
    cte(f"{prefix}_raw", (source,), f"""
WITH plain AS (
  SELECT {key}, unnest(l) AS raw, NULL AS anchor_text, generate_subscripts(l, 1) AS ord
  FROM (SELECT {key}, regexp_extract_all({text}, {s(P.URL)}) AS l FROM {source})),
a AS (
  SELECT {key}, trim(unnest(h)) AS raw, unnest(t) AS inner_html, generate_subscripts(h, 1) AS ord
  FROM (SELECT {key}, regexp_extract_all({html}, {s(P.ANCHOR)}, 1) AS h, regexp_extract_all({html}, {s(P.ANCHOR)}, 2) AS t
        FROM {source})),
anch AS (
  SELECT {key}, raw, trim(regexp_replace(regexp_replace(arg_max(inner_html, ord), {s(P.HTML_TAG)}, ' ', 'g'), '\\s+', ' ', 'g')) AS anchor_text,
         1000000 + min(ord) AS ord FROM a GROUP BY {key}, raw),
c AS (
  SELECT {key}, regexp_replace(raw, {s(P.URL_TRAILING)}, '') AS raw, anchor_text, ord
  FROM (SELECT * FROM plain UNION ALL SELECT * FROM anch))
SELECT {key}, raw, anchor_text, row_number() OVER (PARTITION BY {key} ORDER BY ord) - 1 AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY {key}, lower(raw) ORDER BY ord) AS rn FROM c WHERE raw <> '') WHERE rn = 1""")
    cte(f"{prefix}_parts", (f"{prefix}_raw", "brand_domain"), f"""
SELECT p.*, b.brand AS owner, CASE WHEN contains(registrable, '.') THEN regexp_extract(registrable, '([^.]*)$', 1) ELSE '' END AS tld,
       lower(split_part(regexp_extract(path, '\\.([^.]*)$', 1), '?', 1)) AS ext,
       lower(CASE WHEN contains(host || path, '%') THEN url_decode(replace(host || path, '+', '%2B')) ELSE host || path END) AS hay,
       regexp_replace(lower(trim(anchor_text)), '/+$', '') AS shown
FROM (SELECT *, {reg('host')} AS registrable FROM (
  SELECT {key}, pos, raw, anchor_text, lower(regexp_extract(norm, {s(P.URL_PARTS)}, 1)) AS scheme,
         lower(split_part(regexp_extract(regexp_extract(norm, {s(P.URL_PARTS)}, 2), '([^@]*)$', 1), ':', 1)) AS host,
         {has(f"regexp_extract(norm, {s(P.URL_PARTS)}, 2)", '^.+@')} AS userinfo,
         regexp_extract(norm, {s(P.URL_PARTS)}, 3) || CASE WHEN regexp_extract(norm, {s(P.URL_PARTS)}, 4) = '?' THEN ''
           ELSE regexp_extract(norm, {s(P.URL_PARTS)}, 4) END AS path
  FROM (SELECT *, CASE WHEN contains(raw, '://') THEN raw ELSE 'http://' || raw END AS norm FROM {prefix}_raw))) p
LEFT JOIN brand_domain b ON b.domain = p.registrable""")
    cte(f"{prefix}_borrowed", (f"{prefix}_parts", "brand_token"), f"""
SELECT DISTINCT u.{key}, u.pos FROM {prefix}_parts u JOIN brand_token t
  ON length(t.token) >= 4 AND contains(u.hay, t.token)
  AND NOT (coalesce(t.brand = u.owner, false) OR (split_part(u.registrable, '.', 1) <> ''
           AND split_part(u.registrable, '.', 1) = replace(t.brand, ' ', '')))""")
    shown_reg = reg("split_part(replace(replace(u.shown, 'https://', ''), 'http://', ''), '/', 1)")
    cte(prefix, (f"{prefix}_parts", f"{prefix}_borrowed"), f"""
SELECT u.{key}, u.pos, u.raw, u.anchor_text, u.scheme, u.host, u.path, u.registrable, u.tld, u.ext, u.userinfo,
  {has('u.host', P.IP_HOST)} AS ip_literal, u.registrable IN {lst(dims.SHORTENERS)} AS shortener,
  contains(u.host, 'xn--') AS punycode, u.tld IN {lst(dims.HIGH_RISK_TLDS)} AS high_risk_tld,
  {has('u.path', P.CREDENTIAL_PATH)} AS credential_path,
  len(regexp_extract_all(u.raw, {s(P.PERCENT_ESCAPE)})) >= 4 AS hex_encoding,
  {dots('u.host')} >= 4 AS deep_subdomain, b.pos IS NOT NULL AS brand_mismatch,
  u.ext IN {lst(dims.DANGEROUS_EXT)} AS dangerous_ext,
  u.ext NOT IN {lst(dims.DANGEROUS_EXT)} AND u.ext IN {lst(dims.ARCHIVE_EXT)} AS archive_ext,
  coalesce(contains(u.shown, '.') AND NOT contains(u.shown, ' ') AND u.shown <> u.host AND contains({shown_reg}, '.')
           AND {shown_reg} <> u.registrable, false) AS anchor_mismatch
FROM {prefix}_parts u LEFT JOIN {prefix}_borrowed b ON b.{key} = u.{key} AND b.pos = u.pos""")


url_ctes("url_facts", "base", "message_id", "body_text", "body")
_HAS = {"url_has_ip_literal": "ip_literal", "url_has_shortener": "shortener", "url_has_punycode": "punycode",
        "url_has_userinfo": "userinfo", "url_has_credential_path": "credential_path",
        "url_has_high_risk_tld": "high_risk_tld", "url_has_brand_mismatch": "brand_mismatch",
        "url_has_anchor_mismatch": "anchor_mismatch", "url_has_dangerous_ext": "dangerous_ext",
        "url_has_archive_ext": "archive_ext", "url_has_hex_encoding": "hex_encoding", "url_deep_subdomain": "deep_subdomain"}
_ANYS = ",\n  ".join(f"CASE WHEN bool_or(u.{v}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {k}" for k, v in _HAS.items())
_SUM = " + ".join(f"u.{f}::INT" for f in FLAGS)
cte("f_url", ("base", "url_facts"), f"""
SELECT b.message_id, count(u.raw)::DOUBLE AS url_count,
  count(DISTINCT CASE WHEN u.registrable <> '' THEN u.registrable END)::DOUBLE AS url_unique_domains, {_ANYS},
  coalesce(max(length(u.raw)), 0)::DOUBLE AS url_max_len, coalesce(avg(length(u.raw)), 0)::DOUBLE AS url_mean_len,
  coalesce(avg((u.scheme = 'https')::INT), 0)::DOUBLE AS url_https_ratio, coalesce(avg({_SUM}), 0)::DOUBLE AS url_flag_density,
  coalesce(avg((u.registrable IN {lst(dims.LEGIT_DOMAINS)})::INT), 0)::DOUBLE AS url_legit_domain_ratio,
  coalesce(bool_or(u.ext IN {lst(dims.HARD_EXECUTABLE_EXT)} AND contains(u.path, '.')), false) AS exec_link
FROM base b LEFT JOIN url_facts u USING (message_id) GROUP BY b.message_id""")

cte("phone_facts", ("base",), f"""
SELECT message_id, raw, digits, ord AS pos,
  substr(CASE WHEN digits LIKE '1%' AND length(digits) = 11 THEN substr(digits, 2) ELSE digits END, 1, 3) IN {lst(dims.TOLL_FREE)} AS toll_free,
  starts_with(raw, '+') AS international
FROM (SELECT *, regexp_replace(raw, '\\D', '', 'g') AS digits,
             row_number() OVER (PARTITION BY message_id, regexp_replace(raw, '\\D', '', 'g') ORDER BY ord) AS rn
      FROM (SELECT message_id, trim(unnest(l)) AS raw, generate_subscripts(l, 1) AS ord FROM (
              SELECT message_id, regexp_extract_all(subject || chr(10) || body_text, {s(P.PHONE_PLAIN)}, 1) AS l FROM base)))
WHERE rn = 1 AND length(digits) BETWEEN 7 AND 15""")
cte("f_phone", ("base", "phone_facts"), f"""
SELECT *, CASE WHEN tel_count > 0 AND tel_call_to_action > 0 AND tel_billing_pretext > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS tel_callback_shape
FROM (SELECT b.message_id, count(p.raw)::DOUBLE AS tel_count, {flag('bool_or(p.toll_free)')} AS tel_toll_free,
  {flag('bool_or(p.international)')} AS tel_international,
  {flag(f"bool_or({has('subject || chr(10) || body_text', P.CALL_TO_ACTION)})")} AS tel_call_to_action,
  {flag(f"bool_or({has('subject || chr(10) || body_text', P.BILLING_PRETEXT)})")} AS tel_billing_pretext
  FROM base b LEFT JOIN phone_facts p USING (message_id) GROUP BY b.message_id)""")

cte("identity", ("sender1",), f"""
SELECT message_id, claimed, list_filter(list_distinct(list_transform(claimed, lambda a: {reg("split_part(a, '@', 2)")})), lambda d: d <> '') AS claimed_domains,
  ctas FROM (
  SELECT message_id, list_distinct(list_filter(flatten(list_transform(
      regexp_extract_all(substr(body_text, 1, 500), {s(P.BODY_FROM_PLAIN)}, 1),
      lambda l: regexp_extract_all(lower(l), {s(P.CLAIMED_ADDRESS)}))), lambda a: a <> address)) AS claimed,
    list_filter(list_transform(regexp_extract_all(body_text, {s(P.BRACKET_CTA)}, 1), lambda t: trim(t)), lambda t: t <> '')[1:5] AS ctas
  FROM sender1)""")
cte("f_identity", ("sender1", "identity", "f_url"), f"""
SELECT message_id, len(claimed)::DOUBLE AS emb_body_sender_count,
  {flag("len(claimed_domains) > 0 AND registrable <> '' AND NOT list_contains(claimed_domains, registrable)")} AS emb_body_sender_mismatch,
  len(ctas)::DOUBLE AS emb_bracket_cta, {flag("len(ctas) > 0 AND url_count = 0")} AS emb_cta_without_url
FROM sender1 JOIN identity USING (message_id) JOIN f_url USING (message_id)""")

_EXT = "CASE WHEN contains(n, '.') THEN lower(regexp_extract(n, '([^.]*)$', 1)) ELSE '' END"
cte("files", ("base",), f"""
SELECT message_id, names, in_body, doubles,
  list_filter(names, lambda n: {_EXT} IN {lst(dims.DANGEROUS_EXT)}) AS dangerous,
  list_filter(names, lambda n: {_EXT} IN {lst(dims.ARCHIVE_EXT)}) AS archives,
  list_filter(in_body, lambda n: {_EXT} IN {lst(dims.DANGEROUS_EXT)}) AS dangerous_in_body
FROM (SELECT message_id, list_filter(string_split(attachments, '|'), lambda n: n <> '') AS names,
  regexp_extract_all(body_text, {s(P.FILENAME_PLAIN)}, 1) AS in_body,
  list_distinct(regexp_extract_all(body_text || ' ' || replace(attachments, '|', ' '), {s(P.DOUBLE_EXT_PLAIN)}, 1)) AS doubles
  FROM base)""")
cte("f_attach", ("files",), """
SELECT message_id, len(names)::DOUBLE AS att_count, len(dangerous)::DOUBLE AS att_dangerous_count, len(archives)::DOUBLE AS att_archive_count,
  len(doubles)::DOUBLE AS att_double_extension, len(dangerous_in_body)::DOUBLE AS att_dangerous_named_in_body,
  len(in_body)::DOUBLE AS att_any_named_in_body FROM files""")

REPEAT = "|".join(re.escape(chr(c)) + "{4,}" for c in (9, *range(32, 127), *range(0xC0, 0x180)))
_N = f"greatest(len({words('body_text')}), 1)"


def quoted(body: str) -> str:
    lines = f"list_filter(list_transform(regexp_extract_all({body}, {s(P.QUOTED_LINE)}, 1), lambda l: trim(l)), lambda l: l <> '')"
    return (f"CASE WHEN {has(body, r'(?m)^\s*>')} THEN coalesce(array_to_string({lines}, ' '), '') "
            f"WHEN {has(body, P.QUOTE_INTRO)} THEN trim(substr(regexp_extract({body}, {s(P.QUOTE_INTRO + r'([\s\S]*)')}, 1), 1, 1500)) ELSE '' END")


def upper_ratio(t: str) -> str:
    return div(kept(t, r"\P{Lu}+"), kept(t, r"\P{L}+"))


def chars(t: str, ch: str) -> str:
    return f"(length({t}) - length(replace({t}, {s(ch)}, '')))::DOUBLE"


TEXT = {
    "txt_subject_len": "length(subject)::DOUBLE",
    "txt_subject_words": f"len({words('subject')})::DOUBLE",
    "txt_subject_upper_ratio": upper_ratio("subject"),
    "txt_subject_is_reply": flag(has("subject", P.REPLY_SUBJECT)),
    "txt_subject_exclaim": chars("subject", "!"),
    "txt_subject_empty": flag("trim(subject) = ''"),
    "txt_body_len": "length(body_text)::DOUBLE",
    "txt_body_words": f"len({words('body_text')})::DOUBLE",
    "txt_body_upper_ratio": upper_ratio("body_text"),
    "txt_body_exclaim_rate": f"{chars('body_text', '!')} / {_N}",
    "txt_body_question_rate": f"{chars('body_text', '?')} / {_N}",
    "txt_has_html": flag(has("body", P.HTML_TAG)),
    "txt_html_hidden_style": flag(f"{has('body', P.HTML_TAG)} AND {has('body', P.HIDDEN_STYLE)}"),
    "txt_html_tag_ratio": f"{count('body', P.HTML_TAG)} / {_N}",
    "txt_zero_width_chars": count("body", P.ZERO_WIDTH),
    "txt_homoglyph_chars": count("subject || ' ' || body_text", "[" + P.CONFUSABLE + "]"),
    "txt_non_ascii_ratio": div(count("body_text", r"[^\x00-\x7F]"), "length(body_text)"),
    "txt_link_char_ratio": f"coalesce(list_sum(list_transform(regexp_extract_all(body, {s(P.LINK_TEXT)}), lambda u: length(u))), 0)::DOUBLE / greatest(length(body), 1)",
    "txt_thread_hijack_marker": flag(has("body", P.THREAD_MARKER)),
    "txt_leet_tokens": count("body_text", P.LEET_PLAIN),
    "txt_intraword_punct_rate": f"{count('body_text', P.INTRAWORD_PUNCT_PLAIN)} / {_N}",
    "txt_spaced_letter_runs": count("body_text", P.SPACED_LETTERS),
    "txt_repeat_char_runs": count("body_text", REPEAT),
    "txt_currency_mentions": count(fold("body_text"), P.CURRENCY),
    "txt_all_caps_words": f"len(list_filter({words('body_text')}, lambda x: length(x) > 3 AND x = upper(x) AND x <> lower(x)))::DOUBLE",
    "txt_mean_word_len": f"list_sum(list_transform({words('body_text')}, lambda x: length(x)))::DOUBLE / {_N}",
    "txt_unique_word_ratio": f"len(list_distinct(list_transform({words('body_text')}, lambda x: lower(x))))::DOUBLE / {_N}",
}
cte("f_text", ("base",), "SELECT message_id, " + ",\n ".join(f"coalesce({v}, 0) AS {k}" for k, v in TEXT.items()) + " FROM base")
cte("f_lex", ("base",), "SELECT message_id, " + ",\n ".join(
    [f"{count('body_text', p)} AS lex_{n}_count" for n, p in BANKS.items()]
    + [f"{count('subject', p)} AS lexsubj_{n}" for n, p in BANKS.items()]) + " FROM base")
cte("f_flags", ("base",), "SELECT message_id, " + ",\n ".join(
    f"{has('lower(subject || chr(32) || body_text)', p)} AS {k}" for k, p in P.TEXT_FLAGS.items()) + " FROM base")


def aligned(pat: str) -> str:
    return f"len(list_filter(regexp_extract_all(auth_results, {s(pat)}, 1), lambda d: {reg('d')} = registrable)) > 0"


def header_domain(col: str) -> str:
    return reg(f"regexp_extract(lower({col}), {s(P.HEADER_DOMAIN)}, 1)")


cte("f_auth", ("sender_facts",), f"""
SELECT message_id, auth_results <> '' AND registrable <> '' AND ({aligned(P.DKIM_I)} OR {aligned(P.DKIM_D)} OR {aligned(P.SPF)}) AS authenticated,
  {has('auth_results', P.AUTH_FAILED)} AS auth_failed, {header_domain('reply_to')} AS reply_domain, {header_domain('return_path')} AS return_domain,
  {has('display_name', P.OFFICIAL_DISPLAY)} AS official_display, contains(domain, 'xn--') AS sender_punycode
FROM sender_facts""")
cte("feat", ("sender_facts", "f_header", "f_url", "f_phone", "f_identity", "f_text", "f_attach", "f_lex", "f_flags", "f_auth"), f"""
SELECT *, CASE WHEN txt_subject_is_reply > 0 OR in_reply_to <> '' OR {quoted('body')} <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS thr_claims_thread,
  0.0::DOUBLE AS thr_fabricated FROM sender_facts
JOIN f_header USING (message_id) JOIN f_url USING (message_id) JOIN f_phone USING (message_id) JOIN f_identity USING (message_id)
JOIN f_text USING (message_id) JOIN f_attach USING (message_id) JOIN f_lex USING (message_id) JOIN f_flags USING (message_id)
JOIN f_auth USING (message_id)""")
