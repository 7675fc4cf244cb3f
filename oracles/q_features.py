"""Oracle SQL of the feature queries."""

from __future__ import annotations

from lurewatch.functions import language as LG
from lurewatch.functions import style as ST
from lurewatch.functions.urls import FLAGS
from lurewatch.plans.features import feature_names
from lurewatch.rules import dims, patterns as P
from lurewatch.rules.lexicons import BANK_NAMES
from lurewatch.sources.corpora import ENTITIES
from oracles.base import count, cte, flag, has, lst, q, rows, s
from oracles.features import BANKS, HEADER, TEXT, fold, kept, quoted, url_ctes, words

ORACLE: dict[str, str] = {}


def rnd(names, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


ORACLE["msg_uid"] = q("""SELECT message_id, substr(sha256(encode(subject) || '\\x00'::BLOB || encode(substr(body, 1, 20000))), 1, 16) AS uid FROM messages""", "messages")
ORACLE["msg_full_text"] = q("SELECT message_id, md5(subject || chr(10) || chr(10) || body_text) AS text_md5, length(subject || chr(10) || chr(10) || body_text) AS n FROM base", "base")
ORACLE["fx_sender_parse"] = q("SELECT message_id, address, display_name, local_part, domain FROM sender1", "sender1")
ORACLE["fx_registrable"] = q("SELECT domain, registrable, tld, count(*) AS n FROM sender1 GROUP BY ALL", "sender1")
ORACLE["fx_entropy"] = q("SELECT message_id, round(hdr_sender_local_entropy, 6) AS bits FROM f_header", "f_header")
ORACLE["fx_brand_claim"] = q("SELECT message_id, claimed_brand, brand_mismatch FROM sender_facts", "sender_facts")
ORACLE["fx_lookalike"] = q("SELECT message_id, registrable, lookalike_of, lookalike_distance FROM sender_facts", "sender_facts")
ORACLE["fx_header_features"] = q(f"SELECT message_id, {rnd(HEADER)} FROM f_header", "f_header")

cte("page_base", (), f"SELECT page_id, html, regexp_replace(html, {s(P.HTML_TAG)}, ' ', 'g') AS page_text FROM pages")
url_ctes("page_urls", "page_base", "page_id", "page_text", "html")
ORACLE["fx_url_extract"] = q("SELECT page_id, pos, raw, anchor_text, scheme, host, path, registrable FROM page_urls", "page_urls")
ORACLE["fx_url_flags"] = q(f"SELECT message_id, raw, {', '.join(FLAGS)} FROM url_facts", "url_facts")
URL_NAMES = [n for n in feature_names() if n.startswith("url_")]
ORACLE["fx_url_features"] = q(f"SELECT message_id, {rnd(URL_NAMES)} FROM f_url", "f_url")
ORACLE["fx_phones"] = q("SELECT message_id, raw, digits, toll_free, international FROM phone_facts", "phone_facts")
ORACLE["fx_phone_features"] = q("SELECT * FROM f_phone", "f_phone")
ORACLE["fx_embedded_identity"] = q("SELECT * FROM f_identity", "f_identity")
ORACLE["fx_text_features"] = q(f"SELECT message_id, {rnd(TEXT)} FROM f_text", "f_text")
ORACLE["fx_homoglyphs"] = f"SELECT lang, count(*) AS docs, CAST(sum(len(regexp_extract_all(text, {s('[' + P.CONFUSABLE + ']')}))) AS BIGINT) AS confusable_letters FROM documents GROUP BY lang"
ORACLE["fx_attachments"] = q("""
SELECT f.*, array_to_string(list_transform(list_filter(list_transform(d, lambda n, i: struct_pack(n := n, i := i)),
    lambda x: list_position(list_transform(d, lambda y: lower(y)), lower(x.n)) = x.i), lambda x: x.n), '|') AS evidence
FROM f_attach f JOIN (SELECT message_id, dangerous || dangerous_in_body AS d FROM files) USING (message_id)""", "f_attach", "files")


def span_sql(field: str, text: str) -> str:
    parts = []
    for name, pat in BANKS.items():
        parts.append(f"""
  SELECT message_id, '{name}' AS lexicon, '{field}' AS field, unnest(m) AS term, generate_subscripts(m, 1) AS i, m, g
  FROM (SELECT message_id, regexp_extract_all({text}, {s(pat)}) AS m, string_split_regex({text}, {s(pat)}) AS g FROM base)""")
    return " UNION ALL ".join(parts)


cte("hits", ("base",), f"""
SELECT message_id, lexicon, field, term, i, span_start, span_start + length(term) AS span_end FROM (
  SELECT message_id, lexicon, field, term, i,
    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS span_start
  FROM ({span_sql('body', 'body_text')} UNION ALL {span_sql('subject', 'subject')}))""")
ORACLE["fx_lexicon_hits"] = q("SELECT message_id, lexicon, field, term, span_start, span_end FROM hits", "hits")
LEX_NAMES = [n for n in feature_names() if n.startswith("lex")]
RATES = ", ".join(f"round(lex_{n}_count * 1000.0 / greatest(txt_body_words, 1), 6) AS lex_{n}_rate" for n in BANK_NAMES)
ORACLE["fx_lexicon_features"] = q(f"SELECT f_lex.*, {RATES} FROM f_lex JOIN f_text USING (message_id)", "f_lex", "f_text")
cte("quotes", ("hits", "base"), """
SELECT message_id, lexicon, min(ord) AS ord, arg_min(quote, ord) AS quote FROM (
  SELECT h.message_id, h.lexicon, CASE WHEN field = 'body' THEN 0 ELSE 1000000 END + i AS ord,
    CASE WHEN greatest(0, span_start - 45) > 0 THEN '…' ELSE '' END
    || trim(regexp_replace(substr(t, greatest(0, span_start - 45) + 1, least(length(t), span_end + 45) - greatest(0, span_start - 45)), '\\s+', ' ', 'g'))
    || CASE WHEN least(length(t), span_end + 45) < length(t) THEN '…' ELSE '' END AS quote
  FROM (SELECT h.*, CASE WHEN h.field = 'body' THEN b.body_text ELSE b.subject END AS t FROM hits h JOIN base b USING (message_id)) h)
GROUP BY message_id, lexicon, lower(quote)""")
ORACLE["fx_quotes"] = q("""
SELECT message_id, lexicon, string_agg(quote, ' | ' ORDER BY ord) AS quotes FROM (
  SELECT *, row_number() OVER (PARTITION BY message_id, lexicon ORDER BY ord) AS rn FROM quotes) WHERE rn <= 2
GROUP BY message_id, lexicon""", "quotes")
ORACLE["fx_auth_aligned"] = q("SELECT message_id, authenticated, auth_failed, reply_domain FROM f_auth", "f_auth")

_SCRIPT_COUNTS = ["len(regexp_extract_all(l, '[\\x{0}-\\x{36F}]')) AS c_Latin"] + [
    f"len(regexp_extract_all(l, '[{r}]')) AS c_{n}" for n, _, r in LG.SCRIPTS]
_TOP = " UNION ALL ".join([f"SELECT doc_id, letters, 'Latin' AS script, 'en' AS script_lang, c_Latin AS n, 0 AS ord FROM sc"] + [
    f"SELECT doc_id, letters, '{n}', '{lang}', c_{n}, {i + 1} FROM sc" for i, (n, lang, _) in enumerate(LG.SCRIPTS)])
cte("doc_script", (), f"""
WITH sc AS (SELECT doc_id, length(l) AS letters, {', '.join(_SCRIPT_COUNTS)} FROM (
  SELECT doc_id, regexp_replace(text, '\\P{{L}}+', '', 'g') AS l FROM documents))
SELECT doc_id, letters, script, script_lang, CASE WHEN letters = 0 THEN 0.0 ELSE n / letters END AS script_share FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ord) AS rn FROM ({_TOP})) WHERE rn = 1""")
ORACLE["fx_language_script"] = q("SELECT doc_id, script, script_lang, round(script_share, 6) AS script_share, letters FROM doc_script", "doc_script")
cte("stopword", (), rows("ord, lang, word", [(i, lang, w) for i, (lang, t) in enumerate(LG.STOPWORDS.items()) for w in sorted(set(t.split()))]))
cte("doc_lang", ("doc_script", "stopword"), f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(trim(text)), '\\p{{L}}+')) AS word FROM documents),
n AS (SELECT doc_id, count(*) AS n_words FROM w GROUP BY doc_id),
sc AS (SELECT w.doc_id, s.lang, s.ord, count(*) AS hits, count(DISTINCT w.word) AS seen FROM w JOIN stopword s USING (word) GROUP BY ALL),
best AS (SELECT doc_id, arg_min(lang, (-hits, ord)) AS lang, max(hits) AS hits, arg_min(seen, (-hits, ord)) AS seen FROM sc WHERE lang <> 'en' GROUP BY doc_id),
j AS (SELECT d.doc_id, coalesce(n.n_words, 0) AS n_words, d.letters, d.script, d.script_lang, d.script_share, b.lang,
        coalesce(b.hits, 0) / greatest(coalesce(n.n_words, 0), 1) AS other, coalesce(b.seen, 0) AS seen,
        coalesce(e.hits, 0) / greatest(coalesce(n.n_words, 0), 1) AS en,
        CASE WHEN d.script = 'Latin' THEN coalesce(n.n_words, 0) < {LG.MIN_WORDS} ELSE d.letters < {LG.MIN_LETTERS} END AS short
      FROM doc_script d LEFT JOIN n USING (doc_id) LEFT JOIN best b USING (doc_id)
      LEFT JOIN (SELECT * FROM sc WHERE lang = 'en') e USING (doc_id)),
k AS (SELECT *, NOT short AND script <> 'Latin' AND script_share >= {LG.MIN_SHARE} AS by_script FROM j),
m AS (SELECT *, NOT short AND NOT by_script AND other >= {LG.MIN_FOREIGN_RATE} AND other / greatest(en, 1e-9) >= {LG.MARGIN} AND seen >= {LG.MIN_DISTINCT} AS by_words FROM k)
SELECT doc_id, CASE WHEN by_script THEN script_lang WHEN by_words THEN lang ELSE 'en' END AS lang_detected, NOT (by_script OR by_words) AS is_english,
  CASE WHEN short THEN 0.0 WHEN by_script THEN round(least(1.0, script_share * 1.5), 3) WHEN by_words THEN round(least(1.0, other * 6), 3)
       ELSE round(least(1.0, en * 6), 3) END AS lang_confidence, n_words FROM m""")
ORACLE["fx_language_stopwords"] = q("SELECT * FROM doc_lang", "doc_lang")

NORM = "substr(trim(regexp_replace(lower(regexp_replace(trim(subject), '(?i)^\\s*(?:re|fw|fwd)\\s*:\\s*', '')), '[^a-z0-9 ]+', '', 'g')), 1, 80)"
ORACLE["fx_subject_norm"] = q(f"SELECT {NORM} AS norm, count(*) AS n FROM messages GROUP BY ALL", "messages")


ORACLE["fx_quoted_text"] = q(f"SELECT message_id, {quoted('body')} AS quoted FROM messages WHERE {quoted('body')} <> ''", "messages")
ORACLE["fx_msgids"] = q(f"SELECT message_id, lower(unnest(regexp_extract_all(in_reply_to, {s(P.MESSAGE_ID)}, 1))) AS ref FROM messages", "messages")


def shingle_rows(source: str, key: str, text: str) -> str:
    """(key, sh): distinct 5-word shingle hashes at the first 400 positions."""
    return f"""SELECT DISTINCT {key}, substr(md5(array_to_string(t[i:i + 4], ' ')), 1, 12) AS sh FROM (
  SELECT {key}, t, unnest(range(1, least(len(t) - 4, 400) + 1)) AS i FROM (
    SELECT {key}, regexp_extract_all(lower({text}), {s(P.WORD_TOKEN)}) AS t FROM {source}))"""


ORACLE["fx_shingles"] = q(f"""
SELECT d.doc_id, count(x.sh) AS n, md5(coalesce(string_agg(x.sh, ' ' ORDER BY x.sh), '')) AS set_md5
FROM documents d LEFT JOIN ({shingle_rows('documents', 'doc_id', 'text')}) x USING (doc_id) GROUP BY d.doc_id""")


def simhash_sql(source: str, key: str, text: str) -> str:
    """Bit sums per text, then the sign of each."""
    sums = ", ".join(f"CAST(sum((lo >> {b}) & 1) AS BIGINT) AS s{b}, CAST(sum((hi >> {b}) & 1) AS BIGINT) AS h{b}" for b in range(32))
    lo = " + ".join(f"(CASE WHEN s{b} * 2 > n THEN {1 << b}::HUGEINT ELSE 0 END)" for b in range(32))
    hi = " + ".join(f"(CASE WHEN h{b} * 2 > n THEN {1 << b}::HUGEINT ELSE 0 END)" for b in range(32))
    return f"""
SELECT k.{key}, CAST(CASE WHEN h IS NULL THEN 0 WHEN h >= 2147483648 THEN (h - 4294967296) * 4294967296 + l ELSE h * 4294967296 + l END AS BIGINT) AS simhash
FROM {source} k LEFT JOIN (SELECT {key}, {hi} AS h, {lo} AS l FROM (
  SELECT {key}, count(*) AS n, {sums} FROM (
    SELECT {key}, ('0x' || substr(md5(g), 1, 8))::BIGINT AS hi, ('0x' || substr(md5(g), 9, 8))::BIGINT AS lo FROM (
      SELECT {key}, array_to_string(t[i:i + 2], ' ') AS g FROM (
        SELECT {key}, t, unnest(range(1, len(t) - 1)) AS i FROM (
          SELECT {key}, regexp_extract_all(lower({text}), {s(P.WORD_TOKEN)}) AS t FROM {source})))) GROUP BY {key})) v USING ({key})"""


ORACLE["fx_simhash"] = simhash_sql("documents", "doc_id", "text")
KEY = "sha1(substr(trim(regexp_replace(lower(subject || ' ' || body), '[^a-z0-9]+', ' ', 'g')), 1, 400))"
ORACLE["fx_content_key"] = q(f"SELECT message_id, {KEY} AS content_key FROM messages", "messages")


def own_words(body: str) -> str:
    cut = f"CASE WHEN {has(body, P.STYLE_QUOTE_INTRO)} THEN string_split_regex({body}, {s(P.STYLE_QUOTE_INTRO)})[1] ELSE {body} END"
    cut = f"regexp_replace({cut}, {s(P.STYLE_QUOTED_LINE)}, '', 'g')"
    cut = f"string_split_regex({cut}, {s(P.STYLE_SIGNATURE)})[1]"
    cut = f"regexp_replace(regexp_replace({cut}, {s(P.STYLE_URL)}, ' ', 'g'), {s(P.STYLE_EMAIL)}, ' ', 'g')"
    return f"regexp_replace({cut}, '^\\s+|\\s+$', '', 'g')"


ORACLE["fx_readable_body"] = q(f"SELECT message_id, md5(o) AS own_md5, length(o) AS n FROM (SELECT message_id, {own_words('body')} AS o FROM messages)", "messages")


def trait_rows(source: str, key: str, text: str) -> str:
    """All traits, one column each."""
    fw = ", ".join(f"1000.0 * len(list_filter(fws, lambda w: w = {s(w)})) / n AS fw_{w}" for w in ST.FUNCTION_WORDS)
    pn = ", ".join(f"1000.0 * (length(own) - length(replace(own, {s(c)}, ''))) / ch AS pn_{k}" for k, c in ST.PUNCTUATION.items())
    gr = ", ".join(f"regexp_matches(coalesce(first_line, ''), {s(p)})::INT::DOUBLE AS gr_{k}" for k, p in ST.GREETINGS.items())
    sg = ", ".join(f"regexp_matches(tail, {s(p)})::INT::DOUBLE AS sg_{k}" for k, p in ST.SIGNOFFS.items())
    found = lambda p: f"len(regexp_extract_all(own, {s(p)}))"
    return f"""
WITH o AS (SELECT {key}, {own_words(text)} AS own FROM {source}),
t AS (SELECT *, regexp_extract_all(lower(own), {s(P.STYLE_TOKEN)}) AS toks FROM o),
r AS (SELECT *, len(toks) AS n, greatest(length(own), 1) AS ch, string_split(own, chr(10)) AS lines, list_filter(string_split_regex(own, '\\s+'), lambda x: x <> '') AS ws,
        list_filter(toks, lambda w: list_contains([{', '.join(s(w) for w in ST.FUNCTION_WORDS)}], w)) AS fws,
        list_transform(list_filter(string_split_regex(own, {s(ST.SENTENCE_BREAK)}), lambda x: regexp_matches(x, '\\S')), lambda x: len(regexp_extract_all(x, '[A-Za-z'']+'))) AS lens,
        regexp_extract_all(own, {s(ST.SENTENCE_START)}, 1) AS starts FROM t WHERE len(toks) >= {ST.MIN_TOKENS}),
l AS (SELECT *, list_filter(lines, lambda x: regexp_matches(x, '\\S'))[1] AS first_line, array_to_string(lines[-4:], chr(10)) AS tail FROM r),
hx AS (SELECT {key}, count(*) AS once FROM (SELECT {key}, tok FROM (SELECT {key}, unnest(toks) AS tok FROM r) GROUP BY ALL HAVING count(*) = 1) GROUP BY {key})
SELECT l.{key}, n AS n_tokens, {fw}, {pn}, {gr}, 0.0::DOUBLE AS gr_none, {sg},
  list_avg(lens) AS st_sentence_len, list_aggregate(lens, 'stddev_pop') AS st_sentence_sd,
  list_avg(list_transform(toks, lambda w: length(w))) AS st_word_len,
  100.0 * len(list_filter(toks, lambda w: length(w) > 6)) / n AS st_long_words,
  100.0 * coalesce(hx.once, 0) / n AS st_hapax,
  100.0 * len(list_filter(ws, lambda w: length(w) > 2 AND w = upper(w) AND w <> lower(w))) / greatest(len(ws), 1) AS st_allcaps,
  1000.0 * {found(ST.CONTRACTION)} / n AS st_contractions,
  100.0 * {kept('own', '[^0-9]+')} / ch AS st_digits,
  1000.0 * {found(ST.EMOJI)} / n AS st_emoji,
  100.0 * len(list_filter(lines, lambda x: NOT regexp_matches(x, '\\S'))) / len(lines) AS st_blank_lines,
  list_avg(list_transform(lines, lambda x: length(x))) AS st_line_len,
  100.0 * {found('[.!?]  +')} / greatest({found('[.!?] ')}, 1) AS st_double_space,
  100.0 * len(list_filter(starts, lambda c: c = lower(c))) / greatest(len(starts), 1) AS st_lower_start
FROM l LEFT JOIN hx USING ({key})"""


ORACLE["fx_style_traits"] = f"SELECT doc_id, n_tokens, {rnd(ST.TRAIT_NAMES, 4)} FROM ({trait_rows('documents', 'doc_id', 'text')})"
ORACLE["fx_style_traits_all"] = f"SELECT doc_id, {rnd(ST.TRAIT_NAMES, 6)} FROM ({trait_rows('documents', 'doc_id', 'text')})"
ORACLE["fx_money_patterns"] = q(f"""
SELECT message_id, len(regexp_extract_all({fold('body_text')}, {s(P.CURRENCY)})) AS sums,
  {has("lower(subject || ' ' || body_text)", P.TEXT_FLAGS['pat_money_ask'])} AS money_ask,
  {has("lower(subject || ' ' || body_text)", P.TEXT_FLAGS['pat_gift_card_ask'])} AS gift_card_ask,
  {has('sender', P.OFFICIAL_DISPLAY)} AS official_sender FROM base""", "base")
ORACLE["fx_quoted_secret"] = f"""
SELECT doc_id, secret <> '' AS found, CASE WHEN secret <> '' THEN substr(upper(sha1(secret)), 1, 5) ELSE '' END AS prefix
FROM (SELECT doc_id, regexp_extract(text, {s(P.QUOTED_SECRET)}, 1) AS secret FROM documents)"""
ORACLE["fx_parse_date"] = q("""
SELECT message_id, raw, CASE WHEN utc IS NULL THEN '' ELSE strftime(utc, '%Y-%m-%d %H:%M:%S') END AS utc, hour(utc) AS hour, isodow(utc) - 1 AS weekday FROM (
  SELECT message_id, CASE WHEN message_id % 17 = 0 THEN 'not a date' ELSE strftime(sent_at, '%a, %d %b %Y %H:%M:%S')
      || CASE WHEN message_id % 3 = 0 THEN ' +0200 (CEST)' ELSE ' GMT' END END AS raw,
    CASE WHEN message_id % 17 = 0 THEN NULL WHEN message_id % 3 = 0 THEN sent_at - INTERVAL 2 HOUR ELSE sent_at END AS utc FROM messages)""", "messages")
cte("aged", ("sender1", "domain_registry"), """
SELECT m.*, greatest(0, date_diff('day', r.registered, CAST(m.sent_at AS DATE))) AS domain_age_days, r.registered IS NOT NULL AS known_age
FROM sender1 m LEFT JOIN domain_registry r ON r.domain = m.registrable""")
ORACLE["fx_age_buckets"] = q(f"""
SELECT message_id, {flag('known_age')} AS dom_age_known, CASE WHEN known_age THEN least(domain_age_days, 10000) ELSE 0 END::DOUBLE AS dom_age_days,
  {flag('known_age AND domain_age_days < 30')} AS dom_age_under_30d, {flag('known_age AND domain_age_days < 180')} AS dom_age_under_180d FROM aged""", "aged")
_MAGIC = list(dims.MAGIC_BYTES)
_KIND = "CASE " + " ".join(f"WHEN starts_with(head_hex, '{m}') THEN '{k}'" for m, k, _ in _MAGIC) + " ELSE 'unknown' END"
_EXPECT = "CASE declared_ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.EXPECTED_TYPE.items()) + " END"
ORACLE["fx_file_type"] = q(f"""
SELECT *, coalesce(real_type <> 'unknown' AND real_type <> {_EXPECT}, false) AS type_mismatch FROM (
  SELECT *, lower(regexp_extract(filename, '([^.]*)$', 1)) AS declared_ext, {_KIND} AS real_type,
    {_KIND} IN {lst([k for _, k, e in _MAGIC if e])} AS executable FROM (
    SELECT message_id, unnest(list_filter(string_split(attachments, '|'), lambda n: n <> '')) AS filename,
      [{', '.join(s(m) for m, _, _ in _MAGIC)}, '00000000'][message_id % {len(_MAGIC) + 1} + 1] || upper(md5(CAST(message_id AS VARCHAR))) AS head_hex
    FROM messages WHERE attachments <> ''))""", "messages")
_LEX_ALL = ", ".join([f"lex_{n}_count" for n in BANK_NAMES] + [f"lexsubj_{n}" for n in BANK_NAMES])
_STATE = ", ".join(f"0.0::DOUBLE AS {n}" for n in ("thr_msgid_resolved", "thr_quote_match", "sty_scored", "sty_drift"))
_DIRECT = [n for n in feature_names() if not n.endswith("_rate") or n.startswith("txt")]
_DIRECT = [n for n in _DIRECT if n not in ("thr_msgid_resolved", "thr_quote_match", "sty_scored", "sty_drift")]
ORACLE["features_all"] = q(f"SELECT message_id, {rnd(_DIRECT)}, {RATES}, {_STATE} FROM feat", "feat")


def html_text(col: str) -> str:
    out = col
    for k, v in ENTITIES.items():
        out = f"replace({out}, {s(k)}, {s(v)})"
    return f"trim(regexp_replace(regexp_replace({out}, {s(P.HTML_TAG)}, ' ', 'g'), '[\\s ]+', ' ', 'g'))"


ORACLE["src_html_text"] = f"SELECT page_id, md5(t) AS text_md5, length(t) AS n FROM (SELECT page_id, {html_text('html')} AS t FROM pages)"
ORACLE["flt_word_count"] = f"SELECT doc_id, len({words('text')}) AS n_words FROM documents WHERE len({words('text')}) BETWEEN 25 AND 400"
ORACLE["flt_readable"] = q(f"""
SELECT message_id, letters, capitals FROM (
  SELECT message_id, subject, b, len(regexp_extract_all(b, '\\p{{L}}')) AS letters, len(regexp_extract_all(b, '\\p{{Lu}}')) AS capitals,
    len(regexp_extract_all(b, '\\s[:,.;!?]\\s')) AS spaced
  FROM (SELECT message_id, subject, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS b FROM messages))
WHERE NOT ({has('subject', P.LIST_SUBJECT)} OR {has('subject', P.LIST_TRAFFIC)} OR {has('b', P.LIST_TRAFFIC)} OR letters < length(b) * 0.55
  OR spaced > 4 OR capitals < letters * 0.01)""", "messages")
_MARK = " UNION ALL ".join(f"SELECT '{n}' AS marker, label, lex_{n}_count + lexsubj_{n} > 0 AS hit FROM lab" for n in BANK_NAMES)
cte("lab", ("f_lex", "messages"), "SELECT f_lex.*, label FROM f_lex JOIN messages USING (message_id)")
ORACLE["agg_marker_precision"] = q(f"""
SELECT marker, malicious, benign, CASE WHEN malicious + benign > 0 THEN round(malicious / (malicious + benign), 6) ELSE 0.0 END AS precision FROM (
  SELECT marker, count(*) FILTER (hit AND label = 1) AS malicious, count(*) FILTER (hit AND label <> 1) AS benign FROM ({_MARK}) GROUP BY marker)""", "lab")
