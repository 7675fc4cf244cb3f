"""Oracle SQL of streaming jobs and file round trips: the batch result of the same input."""

from __future__ import annotations

from lurewatch.functions import style as ST
from lurewatch.rules import patterns as P
from oracles.base import cte, q, s
from oracles.q_features import trait_rows
import oracles.scoring  # noqa: F401  its CTEs

ORACLE: dict[str, str] = {}
ORACLE["st_source"] = q("SELECT mailbox, count(*) AS n FROM messages GROUP BY 1", "messages")
ORACLE["st_dedupe"] = q("SELECT DISTINCT md5(body) AS key FROM messages", "messages")
ORACLE["st_baseline"] = q("SELECT message_id, kind FROM messages WHERE sent_at >= TIMESTAMP '2024-01-10'", "messages")

# scoring of a stream: no mailbox history, no recipients
ORACLE["st_score_alert"] = q("SELECT message_id, severity, band, vector, round(p_final, 6) AS p_final FROM sev0 WHERE band IN ('MEDIUM', 'HIGH', 'CRITICAL')", "sev0")
ORACLE["st_actions"] = q("SELECT message_id, CASE WHEN severity < 40 OR binding = 0 OR vector = 'benign' THEN 'false' ELSE 'true' END AS would_act, 'false' AS performed FROM sev0", "sev0")
cte("mail_traits", ("messages",), trait_rows("messages", "message_id", "body"))
cte("trusted", ("mail_traits", "sev0", "sender1"), f"""SELECT m.registrable AS address, trait, value FROM (
  SELECT message_id, unnest([{", ".join(s(t) for t in ST.TRAIT_NAMES)}]) AS trait, unnest([{", ".join(f"CAST({t} AS DOUBLE)" for t in ST.TRAIT_NAMES)}]) AS value FROM mail_traits)
JOIN sev0 v USING (message_id) JOIN sender1 m USING (message_id) WHERE v.p_final < 0.5 AND v.binding = 0""")
ORACLE["st_style_update"] = q("SELECT address, trait, count(value) AS n, round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS sd FROM trusted GROUP BY 1, 2", "trusted")
ORACLE["st_history_update"] = q("""SELECT address, count(*) FILTER (direction = 'received') AS received, count(*) FILTER (direction = 'sent') AS sent_to, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen
FROM mail_log GROUP BY 1""", "mail_log")
ORACLE["st_thread_index"] = q("SELECT message_id, q_shingles, q_found FROM sh_match", "sh_match")
ORACLE["st_band_counts"] = q("""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS win, band AS kind, count(*) AS n FROM (
  SELECT date_trunc('hour', sent_at) AS w, band, max(sent_at) OVER () AS last FROM sev JOIN (SELECT message_id, sent_at FROM messages) USING (message_id))
WHERE w + INTERVAL 2 HOUR <= last GROUP BY 1, 2""", "sev", "messages")
ORACLE["st_sliding_counts"] = """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS win, event_type AS kind, count(*) AS n FROM (
  SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 12 HOUR]) AS w FROM events) GROUP BY 1, 2"""
ORACLE["st_session_counts"] = """SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS win, event_type AS kind, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS sid FROM (
    SELECT event_id, event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev FROM events)) GROUP BY event_type, sid"""
ORACLE["src_csv_corpora"] = q("SELECT message_id, md5(body) AS body_md5, CAST(label AS BIGINT) AS label FROM messages", "messages")
ORACLE["src_psv"] = "SELECT count(*) AS n, count(*) FILTER (l_linenumber <> 2) AS numbers, round(sum(CASE WHEN l_linenumber <> 2 THEN l_quantity END)::DOUBLE, 2) AS total FROM lineitem"
ORACLE["src_raw_mail"] = q("SELECT message_id, sender, subject, strftime(sent_at, '%Y-%m-%d %H:%M:%S') AS sent, md5(body) AS body_md5 FROM messages", "messages")
ORACLE["sink_incident_json"] = q("SELECT message_id, band, vector, severity, NULL AS body FROM sev WHERE band IN ('MEDIUM', 'HIGH', 'CRITICAL')", "sev")
ORACLE["sink_audit_log"] = q("SELECT CASE WHEN severity < 40 OR binding = 0 OR vector = 'benign' THEN 'false' ELSE 'true' END AS would_act, 'true' AS dry_run, count(*) AS n FROM sev GROUP BY 1", "sev")
ORACLE["agg_tracked_files"] = q("""SELECT a.digest, count(*) AS n, arg_min(a.message_id, (a.sent_at, a.message_id)) AS message_id, arg_min(f.address, (a.sent_at, a.message_id)) AS address, arg_min(s.vector, (a.sent_at, a.message_id)) AS vector
FROM attachment_files a JOIN sev s USING (message_id) JOIN (SELECT message_id, address FROM feat) f USING (message_id) WHERE s.severity >= 40 GROUP BY 1""", "attachment_files", "sev", "feat")
ORACLE["join_hash_reputation"] = q("SELECT message_id, digest, total IS NOT NULL AS known, round(bad / total, 6) AS detection_ratio FROM attachment_files LEFT JOIN hash_reputation USING (digest)", "attachment_files", "hash_reputation")
ORACLE["join_breach_prefix"] = q("""
WITH w AS (SELECT w, count(*) AS n FROM (SELECT DISTINCT item_id, unnest(string_split_regex(text, '\\s+')) AS w FROM benchmark) WHERE length(w) >= 6 GROUP BY 1),
m AS (SELECT message_id, list_filter(string_split_regex(body, '\\s+'), lambda x: regexp_matches(x, '^[a-z]{6,12}$'))[1] AS word FROM messages)
SELECT message_id, word IS NOT NULL AS secret_quoted, w.n IS NOT NULL AS exposed, coalesce(w.n, 0) AS n FROM m LEFT JOIN w ON w.w = m.word""", "messages")
ORACLE["ev_evasions"] = q("""
WITH k AS (SELECT message_id, kind FROM messages), b AS (SELECT kind, arg_min(floor, (-n, floor)) AS f FROM (SELECT kind, floor, count(*) AS n FROM floors JOIN k USING (message_id) GROUP BY 1, 2) GROUP BY 1)
SELECT k.kind AS technique, count(*) AS n, count(*) FILTER (s.p_final < 0.5) AS passed, coalesce(any_value(b.f), '') AS still_fires FROM k JOIN sev s USING (message_id) LEFT JOIN b USING (kind)
GROUP BY 1 ORDER BY passed DESC, technique LIMIT 8""", "messages", "floors", "sev")
