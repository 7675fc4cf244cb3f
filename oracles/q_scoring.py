"""Oracle SQL of the scoring queries."""

from __future__ import annotations

from lurewatch.operators.learner import TACTICS
from lurewatch.rules import dims, taxonomy as X
from oracles.base import lst, q, rows, s
from oracles.scoring import EXPLOIT, TARGET, mult, prior

ORACLE: dict[str, str] = {}
VERDICT = "CASE WHEN p_final >= 0.5 THEN 'MALICIOUS' WHEN p_final >= 0.2 THEN 'SUSPICIOUS' ELSE 'BENIGN' END AS verdict"
DECIDED = "CASE WHEN binding > 0 THEN 'deterministic rule' ELSE 'model' END AS decided_by"

ORACLE["sc_prior_adjust"] = q(f"""SELECT message_id, round(p, 6) AS p, round({prior('p', 0.05)}, 6) AS at_5pct, round({prior('p', 0.02)}, 6) AS at_2pct,
  round(p, 6) AS "off", round(p, 6) AS certain FROM scored""", "scored")
ORACLE["sc_floors"] = q("SELECT message_id, floor, minimum FROM floors", "floors")
ORACLE["sc_floor_apply"] = q("SELECT message_id, round(p_prior, 6) AS p_prior, round(p_final, 6) AS p_final, fired, binding FROM fl", "fl")
ORACLE["sc_floor_vector"] = q("SELECT message_id, vector, floor FROM fl_implied", "fl_implied")
ORACLE["join_floor_vector"] = q("""SELECT i.message_id, i.vector, b.minimum, b.mapped FROM fl_implied i JOIN (
  SELECT message_id, max(minimum) AS minimum, count(*) AS mapped FROM fl_binding WHERE vector IS NOT NULL GROUP BY 1) b USING (message_id)""", "fl_implied", "fl_binding")
ORACLE["sc_votes"] = q("SELECT message_id, lf, vector, weight FROM votes", "votes")
ORACLE["sc_vote_resolve"] = q("SELECT message_id, rule_vector, rule_confidence, rule_weight FROM resolved", "resolved")
ORACLE["win_vote_margin"] = q("""SELECT message_id, rule_weight AS winner_weight, runner_up_weight, round(rule_weight / total_weight, 6) AS share,
  round((rule_weight - runner_up_weight) / rule_weight, 6) AS margin FROM resolved WHERE total_weight > 0""", "resolved")
ORACLE["sc_vector_resolve"] = q("SELECT message_id, vector, round(vector_confidence, 6) AS vector_confidence, vector_source FROM sev_v", "sev_v")
ORACLE["sc_exploitability"] = q(f"SELECT message_id, round({EXPLOIT}, 6) AS exploitability FROM feat", "feat")
ORACLE["sc_targeting"] = q(f"SELECT message_id, round({TARGET}, 6) AS targeting FROM feat", "feat")
ORACLE["agg_recipient_profile"] = q("SELECT * REPLACE (round(finance_rate, 6) AS finance_rate, round(credentials_rate, 6) AS credentials_rate, round(vendor_rate, 6) AS vendor_rate, round(hr_rate, 6) AS hr_rate, round(executive_rate, 6) AS executive_rate) FROM recipients", "recipients")
ORACLE["sc_recipient_mult"] = q(f"SELECT message_id, vector AS rule_vector, round(r_mult, 6) AS r_mult FROM ({mult('resolved', 'rule_vector')})", "resolved", "exposure", "recipients")
ORACLE["join_recipient"] = q(f"SELECT mailbox, r_area, count(*) AS n, round(avg(r_mult), 6) AS mean_mult, max(r_messages) AS messages FROM ({mult('resolved', 'rule_vector')}) WHERE r_area IS NOT NULL GROUP BY 1, 2", "resolved", "exposure", "recipients")
ORACLE["sc_severity"] = q("""SELECT message_id, vector, round(impact, 6) AS impact, round(exploitability, 6) AS exploitability, round(targeting, 6) AS targeting,
  escalation, base_score, severity, band FROM sev""", "sev")
ORACLE["sc_pipeline"] = q(f"""SELECT message_id, round(p_model, 6) AS p_model, round(p_prior, 6) AS p_prior, round(p_final, 6) AS p_final, {VERDICT}, {DECIDED},
  vector, vector_source, severity, band, binding FROM sev5""", "sev5")
ORACLE["prj_verdict"] = q(f"SELECT message_id, round(p_final, 6) AS p_final, {VERDICT}, {DECIDED} FROM fl", "fl")
ORACLE["flt_band_floor"] = q("SELECT message_id, band, severity FROM sev WHERE band IN ('MEDIUM', 'HIGH', 'CRITICAL')", "sev")
ORACLE["flt_action_policy"] = q("""
SELECT message_id, NOT (severity < 40 OR binding = 0 OR vector = 'benign') AS act,
  CASE WHEN severity < 40 THEN format('severity {:.1f} below threshold 40', severity) WHEN binding = 0 THEN 'no deterministic rule fired'
       WHEN vector = 'benign' THEN 'vector is benign' ELSE format('severity {:.1f} >= 40', severity) || CASE WHEN first_rule <> '' THEN ', rule ' || first_rule ELSE '' END END AS reason
FROM sev""", "sev")
ORACLE["prj_iocs"] = q("""
SELECT message_id, 'sender_address' AS kind, address AS value FROM sender1 WHERE address <> ''
UNION ALL SELECT message_id, 'sender_domain', registrable FROM sender1 WHERE registrable <> ''
UNION ALL SELECT message_id, 'url', raw FROM url_facts
UNION ALL SELECT DISTINCT message_id, 'url_domain', registrable FROM url_facts WHERE registrable <> ''
UNION ALL SELECT message_id, 'attachment', unnest(names) FROM files
UNION ALL SELECT message_id, 'dangerous_file', n FROM (
  SELECT message_id, n, row_number() OVER (PARTITION BY message_id, lower(n) ORDER BY i) AS rn FROM (
    SELECT message_id, unnest(dangerous || dangerous_in_body) AS n, generate_subscripts(dangerous || dangerous_in_body, 1) AS i FROM files)) WHERE rn = 1""", "sender1", "url_facts", "files")
ORACLE["prj_card"] = q(f"""SELECT message_id, subject, address, registrable, {VERDICT}, sev.vector, severity, band, CAST(url_count AS BIGINT) AS links,
  CAST(att_count AS BIGINT) AS files, first_rule AS top_rule FROM sev JOIN (SELECT message_id, subject, address, registrable, url_count, att_count FROM feat) USING (message_id)""", "sev", "feat")
ORACLE["prj_detail"] = q("""
SELECT message_id, address, display_name, claimed_brand, lookalike_of, authenticated, round(p_model, 6) AS p_model, round(p_prior, 6) AS p_prior,
  round(p_final, 6) AS p_final, sev.vector, rule_vector, rule_confidence, severity, band, coalesce(l.links, '') AS links, coalesce(n.numbers, '') AS numbers,
  coalesce(names, '') AS rules, coalesce(v.votes, '') AS votes
FROM sev JOIN (SELECT message_id, address, display_name, claimed_brand, lookalike_of, authenticated FROM feat) USING (message_id)
LEFT JOIN (SELECT message_id, string_agg(raw, ' ' ORDER BY pos) AS links FROM url_facts GROUP BY 1) l USING (message_id)
LEFT JOIN (SELECT message_id, string_agg(digits, ' ' ORDER BY pos) AS numbers FROM phone_facts GROUP BY 1) n USING (message_id)
LEFT JOIN (SELECT message_id, string_agg(lf, ',' ORDER BY ord) AS votes FROM votes GROUP BY 1) v USING (message_id)""", "sev", "feat", "url_facts", "phone_facts", "votes")
_STEPS = rows("vector, pos, step", [(v, i, st) for v, t in X.PLAYBOOK.items() for i, st in enumerate(t.split("|"))])
_POST = rows("band, posture", X.POSTURE.items())
ORACLE["prj_response_plan"] = q(f"SELECT message_id, vector, band, posture, pos, step FROM (SELECT message_id, vector, band FROM sev) JOIN ({_STEPS}) USING (vector) JOIN ({_POST}) USING (band)", "sev")
ORACLE["join_taxonomy"] = q(f"""SELECT r.message_id, r.vector, coalesce(d.impact, {X.DEFAULT_IMPACT})::DOUBLE AS impact, d.name, d.mitre FROM (
  SELECT message_id, CASE WHEN message_id % 7 = 0 THEN 'unheard_of' ELSE rule_vector END AS vector FROM resolved) r LEFT JOIN vector_dim d USING (vector)""", "resolved", "vector_dim")
ORACLE["srt_triage"] = q("""SELECT message_id, subject, address, sev.vector, severity, band, first_rule AS rule FROM sev JOIN (SELECT message_id, subject, address FROM feat) USING (message_id)
ORDER BY severity DESC, message_id LIMIT 40""", "sev", "feat")
_BANDS = rows("band", [(b,) for _, b in X.BANDS])
ORACLE["agg_triage_counts"] = q(f"SELECT b.band, count(s.message_id) AS n, count(*) FILTER (s.p_final >= 0.5) AS flagged FROM ({_BANDS}) b LEFT JOIN sev s USING (band) GROUP BY 1", "sev")
ORACLE["agg_band_by_vector"] = q("SELECT vector, " + ", ".join(f"count(*) FILTER (band = '{b}') AS {b.lower()}" for _, b in X.BANDS) + " FROM sev GROUP BY 1", "sev")
ORACLE["agg_coverage"] = q("""
SELECT count(*) AS n, count(*) FILTER (fl) AS flagged, count(*) FILTER (fl AND vector_source = 'rule' AND vector <> 'malicious_unclassified') AS by_rule,
  count(*) FILTER (fl AND vector = 'malicious_unclassified') AS unresolved,
  round(avg((vector <> 'malicious_unclassified')::INT) FILTER (fl), 6) AS plan_share, round(avg((n_iocs > 2)::INT), 6) AS ioc_share,
  round(avg(n_iocs) FILTER (fl), 6) AS ioc_mean, round(avg((label = 1)::INT) FILTER (fl AND band IN ('HIGH', 'CRITICAL', 'MEDIUM')), 6) AS band_precision
FROM (SELECT s.*, s.p_final >= 0.5 AS fl, f.url_count + f.att_count + 2 AS n_iocs FROM sev s JOIN (SELECT message_id, url_count, att_count FROM feat) f USING (message_id))""", "sev", "feat")
ORACLE["ev_floor_audit"] = q("""
SELECT floor, count(*) AS fired, count(*) FILTER (label = 0) AS fired_benign, count(*) FILTER (p_prior < 0.5 AND minimum > p_prior AND label = 1) AS new_tp,
  count(*) FILTER (p_prior < 0.5 AND minimum > p_prior AND label = 0) AS new_fp, round(count(*) FILTER (label = 0) / count(*), 6) AS benign_rate
FROM floors JOIN fl USING (message_id) GROUP BY floor""", "floors", "fl")
ORACLE["join_ioc"] = q("SELECT message_id FROM ioc_ids", "ioc_ids")
ORACLE["set_ioc_intersect"] = q("SELECT domain FROM seen_domains INTERSECT SELECT domain FROM ioc_list", "seen_domains", "ioc_list")
ORACLE["join_allowlist"] = q(f"""SELECT u.message_id, m.registrable, u.registrable AS link, u.raw FROM url_facts u JOIN sender1 m USING (message_id)
WHERE u.ext IN {lst(dims.HARD_EXECUTABLE_EXT)} AND m.registrable NOT IN ('203.0.113.9', 'partner.example.net', 'example.net')
  AND u.registrable NOT IN ('203.0.113.9', 'partner.example.net', 'example.net')""", "url_facts", "sender1")
ORACLE["join_domain_age"] = q("SELECT message_id, registrable, CASE WHEN known_age THEN domain_age_days END AS domain_age_days FROM aged", "aged")
_DIM = rows("d, k", [(v, "freemail") for v in dims.FREEMAIL] + [(v, "brand") for v in dims.LEGIT_DOMAINS] + [(v, "shortener") for v in dims.SHORTENERS])
ORACLE["join_dims"] = q(f"""SELECT registrable, k AS kind, count(*) AS n FROM sender1 JOIN ({_DIM}) ON d = registrable GROUP BY 1, 2
UNION ALL SELECT registrable, 'high_risk_tld', count(*) FROM sender1 WHERE tld IN {lst(dims.HIGH_RISK_TLDS)} GROUP BY 1""", "sender1")
ORACLE["join_lookalike"] = q("SELECT registrable, lookalike_of, distance FROM lookalikes", "lookalikes")
ORACLE["flt_auth_ham"] = q("SELECT registrable, count(*) FILTER (authenticated) AS kept, count(*) FILTER (NOT authenticated) AS skipped FROM feat GROUP BY 1", "feat")
ORACLE["agg_top_domains"] = q("SELECT registrable, count(*) AS n FROM feat WHERE authenticated GROUP BY 1 ORDER BY n DESC, registrable LIMIT 8", "feat")


def lx(*banks: str) -> str:
    return " OR ".join(f"lex_{b}_count + lexsubj_{b} > 0" for b in banks)


_WHEN = {
    "sender_identity": "brand_mismatch OR lookalike_of IS NOT NULL OR is_freemail OR display_name <> ''",
    "urgency": lx("urgency", "threat"), "authority": lx("authority", "identity_claim", "impersonated_brand", "govt_impersonation"),
    "links": "url_count > 0", "credentials": lx("credential_request", "it_support"), "payment": lx("payment", "money_request", "crypto"),
    "attachments": "att_count > 0 OR att_dangerous_named_in_body > 0 OR att_any_named_in_body > 0", "pretext": "true",
    "reply_channel": f"tel_count > 0 OR {lx('job_scam')} OR tel_call_to_action > 0",
    "context": "thr_claims_thread > 0 OR txt_subject_is_reply > 0",
}
TACTIC_ROWS = " UNION ALL ".join(f"SELECT message_id, '{t}' AS tactic FROM feat WHERE {_WHEN[t]}" for t in TACTICS)
ORACLE["tac_available"] = q(TACTIC_ROWS, "feat")
