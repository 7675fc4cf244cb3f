"""Oracle SQL of the corpus queries."""

from __future__ import annotations

from lurewatch.rules.lexicons import TELL_BANKS
from oracles.base import cte, lst, q, s

ORACLE: dict[str, str] = {}
KEY = "sha1(substr(trim(regexp_replace(lower(subject || ' ' || body), '[^a-z0-9]+', ' ', 'g')), 1, 400))"


def bucket(key: str, salt: str = "") -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR) || '{salt}'), 1, 8))::BIGINT % 100)"


ORACLE["src_normalise"] = q(r"""
SELECT message_id, 'flat' AS source, regexp_extract(w, '(?s)^\s*Subject:\s*(.*?)(?:\r?\n|\s{2,})(.*)$', 1) AS subject, CAST(label AS BIGINT) AS label,
  md5(regexp_extract(w, '(?s)^\s*Subject:\s*(.*?)(?:\r?\n|\s{2,})(.*)$', 2)) AS body_md5, '' AS sender, '' AS date
FROM (SELECT message_id, label, 'Subject: ' || subject || '  ' || body AS w FROM messages
      WHERE message_id % 9 <> 0 AND message_id % 10 <> 0 AND message_id % 11 <> 0)""", "messages")
ORACLE["src_header_only"] = q("""SELECT message_id, trim(sender) AS from_raw, trim(receiver) AS to_raw,
  strftime(sent_at, '%-d %b %Y %H:%M:%S') || ' +0000' AS date_raw FROM messages""", "messages")
ORACLE["src_optional_union"] = q("""SELECT message_id, source, subject, CAST(label AS BIGINT) AS label, '' AS reply_to FROM messages
UNION ALL SELECT page_id + 1000000000, 'pages', '', NULL, url FROM pages""", "messages")
ORACLE["set_union_sources"] = q("""SELECT source, kind, count(*) AS n FROM (SELECT source, 'message' AS kind FROM messages UNION ALL SELECT source, 'document' FROM documents) GROUP BY 1, 2""", "messages")
ORACLE["src_domain_list"] = "SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS domain FROM pages WHERE page_id % 5 <> 0 AND regexp_extract(url, '^[a-z]+://([^/]+)', 1) <> ''"
ORACLE["src_parquet_cache"] = q(f"""SELECT CASE WHEN {bucket('message_id')} < 20 THEN 'test' ELSE 'train' END AS split, kind, count(*) AS n,
  sum(url_count) AS urls, sum(txt_body_words) AS words FROM feat GROUP BY 1, 2""", "feat")
ORACLE["sink_review_csv"] = q("""SELECT message_id, source, subject, md5(substr(trim(regexp_replace(body, '\\s+', ' ', 'g')), 1, 500)) AS preview_md5, '' AS true_vector FROM messages""", "messages")
ORACLE["flt_mailbox_query"] = q("""SELECT message_id FROM messages WHERE sent_at >= TIMESTAMP '2024-01-20' - INTERVAL 60 DAY AND message_id % 3 = 0 AND contains(lower(sender), 'gmail')""", "messages")
ORACLE["flt_limit_latest"] = q("""SELECT message_id, strftime(sent_at, '%Y-%m-%d %H:%M:%S') AS sent FROM messages ORDER BY sent DESC, message_id DESC LIMIT 50""", "messages")
cte("corpus", (), """
SELECT d.doc_id AS message_id, d.source, '' AS subject, d.text AS body, coalesce(l.toxic, d.doc_id % 2) AS label
FROM documents d LEFT JOIN labels l USING (doc_id)""")
cte("keyed", ("corpus",), f"""SELECT *, {KEY} AS content_key, TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) AS source_rank FROM corpus""")
ORACLE["agg_source_counts"] = q("""SELECT coalesce(source, 'TOTAL') AS source, count(*) AS n, count(*) FILTER (label = 1) AS malicious, count(*) FILTER (label = 0) AS benign,
  round(count(*) FILTER (label = 1) / count(*), 6) AS share FROM corpus GROUP BY ROLLUP (source)""", "corpus")
ORACLE["agg_label_conflicts"] = q("SELECT content_key, count(*) AS n FROM keyed GROUP BY 1 HAVING count(DISTINCT label) > 1", "keyed")
ORACLE["win_dedupe_first"] = q("""SELECT content_key, message_id, source, CAST(label AS BIGINT) AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY content_key ORDER BY source_rank NULLS FIRST, message_id) AS rn FROM keyed
  WHERE content_key NOT IN (SELECT content_key FROM keyed GROUP BY 1 HAVING count(DISTINCT label) > 1)) WHERE rn = 1""", "keyed")
ORACLE["win_dedupe_per_mailbox"] = q("""SELECT mailbox, mid, message_id FROM (
  SELECT mailbox, CAST(message_id % 97 AS VARCHAR) AS mid, message_id, row_number() OVER (PARTITION BY mailbox, message_id % 97 ORDER BY sent_at, message_id) AS rn FROM messages) WHERE rn = 1""", "messages")
cte("split", ("keyed",), f"SELECT *, CASE WHEN {bucket('content_key')} < 20 THEN 'test' ELSE 'train' END AS split FROM keyed")
ORACLE["smp_group_split"] = q("SELECT message_id, split FROM split", "split")
ORACLE["smp_calibration_slice"] = q(f"SELECT CASE WHEN split = 'train' AND {bucket('content_key', 'calib')} < 15 THEN 'calib' ELSE split END AS split, count(*) AS n FROM split GROUP BY 1", "split")
ORACLE["agg_split_label"] = q("SELECT split, count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS malicious FROM split GROUP BY 1", "split")
ORACLE["set_split_except"] = q("SELECT DISTINCT content_key FROM split WHERE split = 'train'", "split")
ORACLE["agg_vector_dist"] = q("""SELECT rule_vector, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(avg(rule_confidence), 6) AS mean_confidence FROM resolved JOIN messages USING (message_id) WHERE label = 1 GROUP BY 1""", "resolved", "messages")


def quota(source: str, group: str, salt: str, limits: dict[str, int], cols: str) -> str:
    case = f"CASE {group} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in limits.items()) + " END"
    return f"""SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY md5(CAST(message_id AS VARCHAR) || '{salt}'), message_id) AS rn FROM ({source})) WHERE rn <= {case}"""


ORACLE["smp_stratified_quota"] = q(quota("""SELECT message_id, CASE WHEN rule_vector = 'malicious_unclassified' THEN 'unresolved' WHEN rule_confidence < 0.7 THEN 'low' ELSE 'high' END AS bucket FROM resolved JOIN messages USING (message_id)
WHERE label = 1 AND (rule_vector = 'malicious_unclassified' OR rule_confidence < 0.7 OR rule_confidence >= 0.9)""",
                                         "bucket", "gold", {"unresolved": 45, "low": 35, "high": 20}, "message_id, bucket"), "resolved", "messages")
cte("pool", ("base", "hits"), f"""
SELECT b.message_id, b.subject, b.sender, b.source, b.label, b.body_text, coalesce(h.n, 0) AS n_spans, coalesce(h.n, 0) > 0 AS has_tell
FROM base b LEFT JOIN (SELECT message_id, least(count(*), 12) AS n FROM hits WHERE field = 'body' AND lexicon IN {lst(TELL_BANKS)} GROUP BY 1) h USING (message_id)""")
ORACLE["smp_practice_pool"] = q(quota("SELECT message_id, CASE WHEN label = 0 THEN 'benign' WHEN has_tell THEN 'tell' ELSE 'plain' END AS cell FROM pool", "cell", "pool", {"benign": 100, "tell": 80, "plain": 20}, "message_id, cell"), "pool")
ORACLE["agg_pool_stats"] = q("""SELECT source, count(*) FILTER (label = 1 AND has_tell) AS hostile_tell, count(*) FILTER (label = 1 AND NOT has_tell) AS hostile_plain,
  count(*) FILTER (label = 0) AS benign, max(n_spans) AS most_spans FROM pool GROUP BY 1""", "pool")
ORACLE["smp_exercise"] = q("""SELECT message_id, subject, sender, md5(trim(regexp_replace(body_text, '\\s+', ' ', 'g'))) AS body_md5, n_spans AS n_tells FROM pool
WHERE label = 1 AND has_tell ORDER BY md5(CAST(message_id AS VARCHAR) || 'highlight') LIMIT 20""", "pool")
ORACLE["smp_triage_mix"] = q(quota("SELECT message_id, CASE WHEN label = 1 THEN 'hostile' ELSE 'benign' END AS cls FROM messages", "cls", "triage", {"hostile": 8, "benign": 16}, "message_id, cls"), "messages")
ORACLE["top_hard_cases"] = q(f"""
WITH t AS (SELECT *, 0 AS ord FROM (SELECT message_id, y, p FROM scored WHERE y = 0 ORDER BY p DESC, message_id LIMIT 25)
 UNION ALL SELECT *, 1 FROM (SELECT message_id, y, p FROM scored WHERE y = 1 ORDER BY p, message_id LIMIT 25)
 UNION ALL SELECT *, 2 FROM (SELECT message_id, y, p FROM scored ORDER BY abs(p - 0.5), message_id LIMIT 25)),
k AS (SELECT message_id, {KEY} AS content_key FROM messages)
SELECT message_id, ['false_positive', 'false_negative', 'uncertain'][ord + 1] AS why, CAST(y AS BIGINT) AS y, round(p, 6) AS p FROM (
  SELECT t.*, row_number() OVER (PARTITION BY content_key ORDER BY ord, message_id) AS rn FROM t JOIN k USING (message_id)) WHERE rn = 1""", "scored", "messages")
ORACLE["flt_verified_quotes"] = q("""
WITH v AS (SELECT c.message_id, c.strength, substr(trim(regexp_replace(lower(c.quote), '\\s+', ' ', 'g')), 1, 60) AS needle,
    trim(regexp_replace(lower(m.subject || ' ' || m.body), '\\s+', ' ', 'g')) AS hay FROM claims c JOIN messages m USING (message_id)),
g AS (SELECT message_id, count(*) AS claims, count(*) FILTER (needle <> '' AND contains(hay, needle)) AS verified, max(strength) AS strength FROM v GROUP BY 1)
SELECT message_id, claims, verified, round(strength * verified / claims, 3) AS verified_strength, round(strength * verified / claims, 3) >= 0.55 AND verified >= 2 AS review FROM g""", "claims", "messages")
ORACLE["agg_percentile_grid"] = """
SELECT l_returnflag, pos, round(value, 4) AS value FROM (
  SELECT l_returnflag, unnest(g) AS value, generate_subscripts(g, 1) - 1 AS pos FROM (
    SELECT l_returnflag, quantile_cont(l_extendedprice, [0.01, 0.05, 0.10, 0.25, 0.40, 0.50, 0.60, 0.75, 0.90, 0.95, 0.99, 1.0]) AS g FROM lineitem GROUP BY 1))"""
ORACLE["lab_consensus"] = q("""
SELECT rule_vector, count(*) AS n, count(*) FILTER (a_vector = b_vector) AS agreed, count(final) AS resolved, round(avg((a_vector = b_vector)::INT), 6) AS rate,
  round(avg((final = rule_vector)::INT), 6) AS rule_accuracy
FROM (SELECT *, CASE WHEN human_vector <> '' THEN human_vector WHEN a_vector = b_vector THEN a_vector END AS final FROM labellers) GROUP BY 1""", "labellers")
