"""Oracle SQL of history, threads and style."""

from __future__ import annotations

from lurewatch.functions import style as ST
from lurewatch.operators import style as STY
from lurewatch.plans.q_mailbox import STYLE_MARKS
from lurewatch.rules import patterns as P
from oracles.base import cte, q, s
from oracles.q_features import shingle_rows, trait_rows

ORACLE: dict[str, str] = {}
_T = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_H = "count(*) FILTER (direction = 'received') AS received, count(*) FILTER (direction = 'sent') AS sent_to"
ORACLE["agg_history"] = q(f"""
SELECT 'address' AS kind, address AS party, {_H}, {_T.format('min(ts)')} AS first_seen, {_T.format('max(ts)')} AS last_seen FROM mail_log GROUP BY address
UNION ALL SELECT 'domain', domain, {_H}, {_T.format('min(ts)')}, {_T.format('max(ts)')} FROM mail_log GROUP BY domain""", "mail_log")
ORACLE["agg_hour_histogram"] = q("""
SELECT domain, 'hour' AS kind, hour(ts) AS slot, count(*) AS n FROM mail_log WHERE direction = 'received' GROUP BY ALL
UNION ALL SELECT domain, 'weekday', isodow(ts) - 1, count(*) FROM mail_log WHERE direction = 'received' GROUP BY ALL""", "mail_log")
cte("h_addr", ("mail_log",), f"SELECT address, {_H}, min(ts) AS first_seen FROM mail_log GROUP BY 1")
cte("h_dom", ("mail_log",), f"""SELECT domain, {_H}, min(ts) AS first_seen, max(ts) AS last_seen, list(DISTINCT hour(ts)) FILTER (direction = 'received') AS hours FROM mail_log GROUP BY 1""")
ORACLE["agg_history_signals"] = q("""
WITH seen AS (SELECT DISTINCT address, domain FROM mail_log),
pr AS (SELECT *, length(address) % 24 AS hour FROM (SELECT * FROM seen UNION ALL
  SELECT DISTINCT 'x' || address, CASE WHEN length(address) % 2 = 0 THEN domain ELSE 'new.example' END FROM seen)),
j AS (SELECT p.*, coalesce(a.received, 0) AS ar, coalesce(a.sent_to, 0) AS asent, coalesce(d.received, 0) AS dr, coalesce(d.sent_to, 0) AS ds,
    a.first_seen AS af, d.first_seen AS df, d.last_seen AS dl, d.hours,
    epoch_us(d.last_seen - d.first_seen) // 86400000000 AS span, epoch_us(TIMESTAMP '2026-01-01' - d.last_seen) // 86400000000 AS gap
  FROM pr p LEFT JOIN h_addr a USING (address) LEFT JOIN h_dom d ON d.domain = p.domain)
SELECT address, domain, ar + asent > 0 AS sender_known, dr + ds > 0 AS domain_known, dr + ds = 0 AS first_contact, ds > 0 AS ever_corresponded,
  CASE WHEN dr > 0 THEN round(least(1.0, ds / dr), 3) ELSE 0.0 END AS reply_rate,
  CASE WHEN coalesce(af, df) IS NOT NULL THEN greatest(0, epoch_us(TIMESTAMP '2026-01-01' - coalesce(af, df)) // 86400000000) END AS days_known,
  CASE WHEN dr >= 3 AND span > 0 AND gap > greatest(120.0, span / greatest(dr - 1, 1) * 8) THEN gap END AS dormant_days,
  coalesce(dr >= 8 AND NOT list_has_any(hours, [hour - 1, hour, hour + 1]), false) AS unusual_hour FROM j""", "mail_log", "h_addr", "h_dom")
ORACLE["join_history"] = q(f"""
WITH a AS (SELECT address, {_H} FROM mail_log GROUP BY 1), b AS (SELECT domain, {_H} FROM mail_log GROUP BY 1)
SELECT event_id, coalesce(a.received, 0) AS a_received, coalesce(a.sent_to, 0) AS a_sent, coalesce(b.received, 0) AS d_received, coalesce(b.sent_to, 0) AS d_sent
FROM mail_log m LEFT JOIN a USING (address) LEFT JOIN b ON b.domain = m.domain""", "mail_log")
ORACLE["join_history_asof"] = q("""
SELECT event_id, coalesce(CAST(sum((direction = 'received')::INT) OVER w AS BIGINT), 0) AS hist_received, coalesce(CAST(sum((direction = 'sent')::INT) OVER w AS BIGINT), 0) AS hist_sent,
  min(epoch_us(ts)) OVER w AS hist_first, max(epoch_us(ts)) OVER w AS hist_last,
  coalesce(CAST(bit_or(CASE WHEN direction = 'received' THEN 1 << hour(ts)::INT ELSE 0 END) OVER w AS BIGINT), 0) AS hist_hours
FROM mail_log WINDOW w AS (PARTITION BY domain ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)""", "mail_log")

cte("body_sh", ("threads",), f"SELECT t.mailbox, t.message_id, t.sent_at, x.sh FROM threads t JOIN ({shingle_rows('threads', 'message_id', 'body')}) x USING (message_id)")
cte("quote_sh", ("threads",), f"SELECT t.mailbox, t.message_id, t.sent_at, x.sh FROM threads t JOIN ({shingle_rows('threads', 'message_id', 'quoted')}) x USING (message_id)")
cte("sh_index", ("body_sh",), "SELECT mailbox, sh, min(sent_at) AS first_seen, arg_min(message_id, (sent_at, message_id)) AS owner FROM body_sh GROUP BY 1, 2")
cte("sh_match", ("quote_sh", "sh_index"), """SELECT q.message_id, count(*) AS q_shingles, count(*) FILTER (i.first_seen < q.sent_at) AS q_found
FROM quote_sh q LEFT JOIN sh_index i USING (mailbox, sh) GROUP BY 1""")
cte("indexed", ("threads",), "SELECT message_id, count(*) OVER (PARTITION BY mailbox ORDER BY sent_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS indexed FROM threads")
ORACLE["agg_thread_index"] = q("""SELECT a.mailbox, messages, ids, shingles, owners FROM (SELECT mailbox, count(*) AS messages, count(DISTINCT message_id) AS ids FROM threads GROUP BY 1) a
JOIN (SELECT mailbox, count(*) AS shingles, count(DISTINCT owner) AS owners FROM sh_index GROUP BY 1) b USING (mailbox)""", "threads", "sh_index")
ORACLE["join_thread_ids"] = q(f"""SELECT DISTINCT message_id FROM (SELECT message_id, lower(unnest(regexp_extract_all(in_reply_to, {s(P.MESSAGE_ID)}, 1))) AS ref FROM messages)
WHERE ref IN (SELECT CAST(message_id AS VARCHAR) || '@box' FROM messages)""", "messages")
ORACLE["join_thread_shingles"] = q("SELECT message_id, q_shingles, q_found, round(q_found / q_shingles, 6) AS ratio FROM sh_match", "sh_match")
ORACLE["win_growing_index"] = q("SELECT message_id, indexed FROM indexed", "indexed")
cte("verdicts", ("threads", "indexed", "sh_match"), f"""
WITH b AS (SELECT t.mailbox, t.message_id, t.quoted <> '' AS claims_thread, i.indexed, len(regexp_extract_all(lower(t.quoted), {s(P.WORD_TOKEN)})) AS q_tokens,
    coalesce(m.q_found / m.q_shingles, 0) AS quote_match FROM threads t JOIN indexed i USING (message_id) LEFT JOIN sh_match m USING (message_id))
SELECT mailbox, message_id, claims_thread, indexed, q_tokens, round(quote_match, 6) AS quote_match, claims_thread AND indexed >= 200 AND quote_match >= 0.25 AS matched,
  claims_thread AND indexed >= 200 AND quote_match < 0.25 AND q_tokens >= 25 AS fabricated,
  claims_thread AND (indexed < 200 OR (quote_match < 0.25 AND q_tokens < 25)) AS indeterminate FROM b""")
ORACLE["sc_thread_verdict"] = q("SELECT message_id, claims_thread, indexed, q_tokens, quote_match, matched, fabricated, indeterminate FROM verdicts", "verdicts")
ORACLE["ev_thread_replay"] = q("""SELECT mailbox, count(*) FILTER (claims_thread) AS claims, count(*) FILTER (matched) AS matched, count(*) FILTER (indeterminate) AS indeterminate,
  count(*) FILTER (fabricated) AS fabricated, round(count(*) FILTER (fabricated) / greatest(count(*) FILTER (claims_thread), 1), 6) AS rate FROM verdicts GROUP BY 1""", "verdicts")

cte("wide_traits", (), trait_rows("documents", "doc_id", "text"))
_NAMES = "[" + ", ".join(s(t) for t in ST.TRAIT_NAMES) + "]"
_VALUES = "[" + ", ".join(f"CAST({t} AS DOUBLE)" for t in ST.TRAIT_NAMES) + "]"
cte("traits", ("wide_traits",), f"""SELECT w.doc_id, d.source AS address, trait, value FROM (SELECT doc_id, unnest({_NAMES}) AS trait, unnest({_VALUES}) AS value FROM wide_traits) w JOIN documents d USING (doc_id)""")
cte("profile", ("traits",), "SELECT address, trait, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM traits GROUP BY 1, 2")
cte("popul", ("profile",), f"SELECT * FROM (SELECT trait, count(*) AS senders, avg(mean) AS pop_mean, stddev_samp(mean) AS pop_sd FROM profile WHERE n >= {ST.MIN_MESSAGES} GROUP BY 1) WHERE senders >= 3")
cte("dev", ("traits", "profile", "popul"), f"""SELECT t.doc_id, t.trait, p.n - 1 AS own_n, (t.value - o.pop_mean) / o.pop_sd AS zm, ((p.n * p.mean - t.value) / (p.n - 1) - o.pop_mean) / o.pop_sd AS zc
FROM traits t JOIN popul o USING (trait) JOIN profile p USING (address, trait) WHERE p.n - 1 >= {ST.MIN_MESSAGES} AND o.pop_sd > 1e-9 AND t.value IS NOT NULL""")
cte("drift", ("dev",), f"""SELECT doc_id, traits, 1 - dot / (na * nb) AS drift FROM (SELECT doc_id, count(*) AS traits, sum(zm * zc) AS dot, sqrt(sum(zm * zm)) AS na, sqrt(sum(zc * zc)) AS nb
FROM dev GROUP BY 1) WHERE traits >= {ST.MIN_TRAITS} AND na > 1e-9 AND nb > 1e-9""")
ORACLE["agg_style_profile"] = q("SELECT address, trait, n, round(mean, 4) AS mean, round(sd, 4) AS sd FROM profile", "profile")
ORACLE["agg_style_population"] = q("SELECT trait, senders, round(pop_mean, 4) AS pop_mean, round(pop_sd, 4) AS pop_sd FROM popul", "popul")
ORACLE["join_style"] = q("SELECT doc_id, trait, own_n, round(zm, 3) AS zm, round(zc, 3) AS zc FROM dev", "dev")
ORACLE["sc_style_drift"] = q(f"SELECT doc_id, traits, round(drift, 4) AS drift, drift > {ST.SUSPICIOUS} AS suspicious FROM drift", "drift")
ORACLE["win_top_traits"] = q("""SELECT doc_id, rank, trait, round(moved, 3) AS moved FROM (
  SELECT doc_id, trait, round(abs(zm - zc), 9) AS moved, row_number() OVER (PARTITION BY doc_id ORDER BY round(abs(zm - zc), 9) DESC, trait) AS rank FROM dev) WHERE rank <= 6""", "dev")

# profiles from the first messages, the others held out and compared with their own sender and with another one
cte("held", ("wide_traits",), f"""SELECT doc_id, source AS address, c >= {ST.MIN_MESSAGES + STY.HELD_OUT} AS usable, rn <= {ST.MIN_MESSAGES} AS base FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS c FROM wide_traits JOIN documents USING (doc_id))""")
cte("t_profile", ("traits", "held"), "SELECT address, trait, count(value) AS n, avg(value) AS mean FROM traits WHERE doc_id IN (SELECT doc_id FROM held WHERE usable AND base) GROUP BY 1, 2")
cte("t_pop", ("t_profile",), f"SELECT * FROM (SELECT trait, count(*) AS senders, avg(mean) AS pop_mean, stddev_samp(mean) AS pop_sd FROM t_profile WHERE n >= {ST.MIN_MESSAGES} GROUP BY 1) WHERE senders >= 3 AND pop_sd > 1e-9")
cte("t_order", ("t_profile",), "SELECT address, row_number() OVER (ORDER BY address) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT address FROM t_profile)")
cte("t_pairs", ("held", "t_order"), """
SELECT doc_id, address AS target, true AS genuine FROM held WHERE usable AND NOT base
UNION ALL SELECT h.doc_id, o.address, false FROM held h JOIN t_order m ON m.address = h.address
JOIN t_order o ON o.place = (m.place + 1 + ('0x' || substr(md5(CAST(h.doc_id AS VARCHAR)), 1, 8))::BIGINT % greatest(m.n - 1, 1)) % m.n AND o.address <> h.address WHERE h.usable AND NOT h.base""")
cte("t_dev", ("t_pairs", "traits", "t_profile", "t_pop"), f"""SELECT x.doc_id, x.target, x.genuine, t.trait, (t.value - o.pop_mean) / o.pop_sd AS zm, (p.mean - o.pop_mean) / o.pop_sd AS zc
FROM t_pairs x JOIN traits t USING (doc_id) JOIN t_pop o USING (trait) JOIN t_profile p ON p.address = x.target AND p.trait = t.trait WHERE p.n >= {ST.MIN_MESSAGES} AND t.value IS NOT NULL""")
cte("t_drift", ("t_dev",), f"""SELECT doc_id, target, genuine, round(1 - dot / (na * nb), 6) AS drift FROM (
  SELECT doc_id, target, genuine, count(*) AS traits, sum(zm * zc) AS dot, sqrt(sum(zm * zm)) AS na, sqrt(sum(zc * zc)) AS nb FROM t_dev GROUP BY 1, 2, 3) WHERE traits >= {ST.MIN_TRAITS} AND na > 1e-9 AND nb > 1e-9""")
cte("t_auc", ("t_drift",), "SELECT a.target, avg(CASE WHEN b.drift > a.drift THEN 1.0 WHEN b.drift = a.drift THEN 0.5 ELSE 0.0 END) AS auc FROM t_drift a JOIN t_drift b USING (target) WHERE a.genuine AND NOT b.genuine GROUP BY 1")
cte("t_measured", ("t_drift", "t_auc"), "SELECT * FROM t_drift WHERE target IN (SELECT target FROM t_auc)")
cte("t_marks", ("t_measured",), f"""SELECT unnest([{', '.join(str(100 * m) for m in STYLE_MARKS)}]) AS pct, round(unnest(g), 6) AS value FROM (SELECT quantile_cont(drift, [{', '.join(map(str, STYLE_MARKS))}]) AS g FROM t_measured WHERE genuine)
UNION ALL SELECT 0.0, {ST.SUSPICIOUS}""")
ORACLE["ev_style_auc"] = q("""
SELECT measure, pct::DOUBLE AS pct, round(value::DOUBLE, 4) AS value FROM (
  SELECT unnest(['senders', 'auc mean', 'auc above half', 'auc median']) AS measure, NULL AS pct,
    unnest([count(*), avg(auc), avg((auc > 0.5)::INT), quantile_cont(auc, 0.5)]) AS value FROM t_auc
  UNION ALL SELECT unnest(['own messages', 'other messages']), NULL, unnest([count(*) FILTER (genuine), count(*) FILTER (NOT genuine)]) FROM t_measured
  UNION ALL SELECT 'threshold', pct, value FROM t_marks
  UNION ALL SELECT unnest(['accused', 'caught']), pct, unnest([avg((drift > value)::INT) FILTER (genuine), avg((drift > value)::INT) FILTER (NOT genuine)]) FROM t_measured, t_marks GROUP BY pct)""", "t_auc", "t_measured", "t_marks")
ORACLE["ev_style_trait_rank"] = q("""SELECT trait, round(sum(moved), 3) AS separation FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY moved DESC, trait) AS rn FROM (SELECT doc_id, trait, round(abs(zm - zc), 9) AS moved FROM t_dev WHERE NOT genuine)) WHERE rn <= 6
GROUP BY 1 ORDER BY round(sum(moved), 6) DESC, trait LIMIT 10""", "t_dev")
