"""Oracle CTEs of the scoring chain."""

from __future__ import annotations

from lurewatch.rules import patterns as P, taxonomy as X
from lurewatch.rules.floors import FLOORS
from lurewatch.rules.votes import VOTES
from oracles import intent  # noqa: F401  its CTEs
from oracles.base import cte, has, rows, s

cte("hist", ("sender1",), """
SELECT *, date_diff('microsecond', to_timestamp(0)::TIMESTAMP, sent_at) AS now_us,
  first_us IS NULL AS first_contact, false AS corresponded, n_before AS hist_received,
  n_before >= 5 AND (epoch_us(sent_at) - first_us) // 86400000000 >= 30 AS established,
  CASE WHEN n_before >= 3 AND (last_us - first_us) // 86400000000 > 0
        AND (epoch_us(sent_at) - last_us) // 86400000000 > greatest(120.0, ((last_us - first_us) // 86400000000) / greatest(n_before - 1, 1) * 8)
       THEN (epoch_us(sent_at) - last_us) // 86400000000 END AS dormant_days,
  n_before >= 8 AND NOT list_has_any(hours, [hour(sent_at) - 1, hour(sent_at), hour(sent_at) + 1]) AS unusual_hour, true AS history_scanned
FROM (SELECT message_id, sent_at, count(*) OVER w AS n_before, min(epoch_us(sent_at)) OVER w AS first_us, max(epoch_us(sent_at)) OVER w AS last_us,
        list(hour(sent_at)) OVER w AS hours
      FROM sender1 WINDOW w AS (PARTITION BY mailbox, registrable ORDER BY sent_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))""")
cte("state", ("feat", "hist", "aged", "intent"), """
SELECT f.*, h.first_contact, h.corresponded, h.hist_received, coalesce(h.established, false) AS established, h.dormant_days,
  coalesce(h.unusual_hour, false) AS unusual_hour, h.history_scanned, CASE WHEN a.known_age THEN a.domain_age_days END AS domain_age_days,
  i.p AS p_model
FROM feat f JOIN hist h USING (message_id) JOIN (SELECT message_id, known_age, domain_age_days FROM aged) a USING (message_id) JOIN intent i USING (message_id)""")
# a stream knows no mailbox history
cte("state0", ("feat", "aged", "intent"), """
SELECT f.*, false AS first_contact, false AS corresponded, 0 AS hist_received, false AS established, NULL::BIGINT AS dormant_days, false AS unusual_hour,
  false AS history_scanned, CASE WHEN a.known_age THEN a.domain_age_days END AS domain_age_days, i.p AS p_model
FROM feat f JOIN (SELECT message_id, known_age, domain_age_days FROM aged) a USING (message_id) JOIN intent i USING (message_id)""")


def prior(p: str, q: float | None) -> str:
    if q is None or not 0 < q < 1:
        return p
    lim = f"greatest(least({p}, {1 - X.ODDS_EPS!r}), {X.ODDS_EPS!r})"
    o = f"({lim} / (1.0 - {lim}) / ({X.TRAIN_PRIOR} / (1.0 - {X.TRAIN_PRIOR})) * ({q} / (1.0 - {q})))"
    return f"{o} / (1.0 + {o})"


def floors(name: str, state: str) -> None:
    cte(name, (state,), " UNION ALL ".join(
        f"SELECT message_id, {i} AS ord, '{f.name}' AS floor, ({f.minimum})::DOUBLE AS minimum, {'NULL' if f.vector is None else s(f.vector)} AS vector FROM {state} WHERE {f.when}"
        for i, f in enumerate(FLOORS)))


def floored(name: str, q: float | None, state: str = "state", floors: str = "floors") -> None:
    """p_prior, p_final and the binding floors under a prior."""
    cte(f"{name}_p", (state,), f"SELECT message_id, label, p_model, {prior('p_model', q)} AS p_prior FROM {state}")
    cte(f"{name}_binding", (f"{name}_p", floors), f"SELECT f.*, p.p_prior FROM {floors} f JOIN {name}_p p USING (message_id) WHERE f.minimum > p.p_prior")
    cte(name, (f"{name}_p", f"{name}_binding", floors), f"""
SELECT p.*, greatest(p_prior, coalesce(b.top, 0)) AS p_final, coalesce(f.n, 0) AS fired, coalesce(b.n, 0) AS binding, coalesce(b.first_rule, '') AS first_rule, b.names
FROM {name}_p p LEFT JOIN (SELECT message_id, max(minimum) AS top, count(*) AS n, arg_min(floor, ord) AS first_rule, string_agg(floor, ',' ORDER BY ord) AS names FROM {name}_binding GROUP BY 1) b USING (message_id)
LEFT JOIN (SELECT message_id, count(*) AS n FROM {floors} GROUP BY 1) f USING (message_id)""")
    cte(f"{name}_implied", (f"{name}_binding",), f"""
SELECT message_id, vector, floor FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY minimum DESC, ord) AS rn
  FROM {name}_binding WHERE vector IS NOT NULL) WHERE rn = 1""")


floors("floors", "state")
floors("floors0", "state0")
floored("fl", None)
floored("fl5", 0.05)
floored("fl0", 0.05, "state0", "floors0")

_VT = " UNION ALL ".join(
    f"SELECT message_id, {i} AS ord, '{v.lf}' AS lf, '{v.vector}' AS vector, ({v.weight})::DOUBLE AS weight FROM feat WHERE {v.when}"
    for i, v in enumerate(VOTES))
cte("votes", ("feat",), _VT)
cte("vector_dim", (), rows("ord, vector, name, impact, mitre", [(i, k, n, imp, ",".join(m)) for i, (k, n, imp, m) in enumerate(X.VECTORS)]))
cte("vote_totals", ("votes", "vector_dim"), """
SELECT v.message_id, v.vector, sum(v.weight) AS w, row_number() OVER (PARTITION BY v.message_id ORDER BY round(sum(v.weight), 9) DESC, min(d.ord)) AS rn
FROM votes v JOIN vector_dim d USING (vector) GROUP BY v.message_id, v.vector""")
cte("resolved", ("feat", "vote_totals"), """
SELECT message_id, mailbox, round(top, 6) AS rule_weight, round(second, 6) AS runner_up_weight, round(total, 6) AS total_weight,
  CASE WHEN round(top, 6) >= 1.0 THEN top_vector ELSE 'malicious_unclassified' END AS rule_vector,
  CASE WHEN round(top, 6) >= 1.0 THEN round(least(1.0, round(top, 6) / round(total, 6) * (0.55 + 0.45 * (round(top, 6) - round(second, 6)) / round(top, 6))), 4) ELSE 0.0 END AS rule_confidence
FROM (SELECT f.message_id, f.mailbox, coalesce(max(t.w) FILTER (t.rn = 1), 0)::DOUBLE AS top, coalesce(max(t.w) FILTER (t.rn = 2), 0)::DOUBLE AS second,
        coalesce(sum(t.w), 0)::DOUBLE AS total, max(t.vector) FILTER (t.rn = 1) AS top_vector
      FROM feat f LEFT JOIN vote_totals t USING (message_id) GROUP BY f.message_id, f.mailbox)""")

_AREAS = ", ".join(f"count(*) FILTER ({has('t', p)}) AS {a}" for a, p in P.EXPOSURE.items())
_RATES = ", ".join(f"least(1.0, {a} / greatest(messages * 0.15, 1.0))::DOUBLE AS {a}_rate" for a in P.EXPOSURE)
cte("recipients", ("messages",), f"""
SELECT *, {_RATES} FROM (SELECT mailbox, count(*) AS messages, {_AREAS} FROM (
  SELECT mailbox, substr(subject || ' ' || body, 1, 6000) AS t FROM messages) GROUP BY mailbox)""")
cte("exposure", (), rows("vector, area, weight", [(v, a, w) for v, (a, w) in X.VECTOR_EXPOSURE.items()]))
_CASE = "CASE e.area " + " ".join(f"WHEN '{a}' THEN r.{a}_rate" for a in P.EXPOSURE) + " END"


def mult(source: str, vector: str) -> str:
    return f"""
SELECT x.message_id, x.{vector} AS vector, x.mailbox, e.area AS r_area, r.messages AS r_messages,
  CASE WHEN r.messages < 50 OR e.area IS NULL THEN 1.0 WHEN {_CASE} >= 0.5 THEN 1.0 + e.weight WHEN {_CASE} <= 0.05 THEN 1.0 - e.weight * 0.4 ELSE 1.0 END::DOUBLE AS r_mult
FROM {source} x LEFT JOIN exposure e ON e.vector = x.{vector} LEFT JOIN recipients r ON r.mailbox = x.mailbox"""


IOCS = ("paypa1.com", "mailer.top", "parcel-fee.xyz")
cte("ioc_list", (), rows("domain", [(d,) for d in IOCS]))
cte("seen_domains", ("sender1", "url_facts"), """
SELECT message_id, registrable AS domain FROM sender1 UNION ALL SELECT message_id, registrable FROM url_facts""")
cte("ioc_ids", ("seen_domains", "ioc_list"), "SELECT DISTINCT message_id FROM seen_domains WHERE domain IN (SELECT domain FROM ioc_list)")


def weights(signals) -> str:
    return "least(1.0, " + " + ".join(f"CASE WHEN {n} > 0 THEN {w} ELSE 0 END" for n, w in signals) + ")::DOUBLE"


EXPLOIT = weights(X.EXPLOIT_WEIGHTS)
TARGET = f"({weights(X.TARGET_WEIGHTS)} * CASE WHEN hdr_recipient_undisclosed > 0 OR lex_spam_bulk_marker_count >= 2 THEN 0.4 ELSE 1.0 END)::DOUBLE"


def band(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {t} THEN '{b}'" for t, b in X.BANDS) + " ELSE 'INFORMATIONAL' END"


def vectors(name: str, fl: str) -> None:
    """Vector, confidence and source by rule, classifier and floor."""
    cte(name, (fl, f"{fl}_implied", "resolved", "clf"), f"""
SELECT * EXCLUDE (vec, conf, src, iv, floor, lifted, named, strong), CASE WHEN p_final < 0.5 THEN 'benign' WHEN lifted THEN iv ELSE vec END AS vector,
  CASE WHEN p_final < 0.5 THEN 1.0 WHEN lifted THEN 0.9 ELSE conf END AS vector_confidence,
  CASE WHEN p_final < 0.5 THEN 'intent model' WHEN lifted THEN 'floor ' || floor ELSE src END AS vector_source FROM (
  SELECT *, iv IS NOT NULL AND (src <> 'rule' OR rule_weight < 2.5) AS lifted FROM (
    SELECT *, CASE WHEN strong THEN rule_vector WHEN clf_p >= 0.55 THEN clf_vector WHEN named THEN rule_vector ELSE 'malicious_unclassified' END AS vec,
      CASE WHEN strong THEN least(1.0, rule_weight / 4) WHEN clf_p >= 0.55 THEN clf_p WHEN named THEN least(1.0, rule_weight / 4) ELSE clf_p END AS conf,
      CASE WHEN strong THEN 'rule' WHEN clf_p >= 0.55 THEN 'classifier' WHEN named THEN 'rule (weak)' ELSE 'unresolved' END AS src FROM (
      SELECT p.*, r.mailbox, r.rule_vector, r.rule_confidence, r.rule_weight, i.vector AS iv, i.floor, r.rule_vector <> 'malicious_unclassified' AS named,
        r.rule_vector <> 'malicious_unclassified' AND r.rule_weight >= 1.8 AS strong, c.clf_vector, c.clf_p
      FROM {fl} p JOIN resolved r USING (message_id) JOIN clf c USING (message_id) LEFT JOIN {fl}_implied i USING (message_id))))""")


def severity(name: str, fl: str, recipients: bool = True) -> None:
    """Severity rows on top of a floored CTE, with list matches and recipient multipliers."""
    vectors(f"{name}_v", fl)
    cte(f"{name}_m", (f"{name}_v", "exposure", "recipients"), mult(f"{name}_v", "vector") if recipients else f"SELECT message_id, 1.0::DOUBLE AS r_mult FROM {name}_v")
    cte(name, (f"{name}_v", f"{name}_m", "feat", "ioc_ids", "vector_dim"), f"""
SELECT *, {band('total')} AS band, round(round(total, 6), 1) AS severity, round(round(base_exact, 6), 1) AS base_score FROM (
  SELECT *, least(100.0, base_exact + escalation) AS total FROM (
    SELECT *, 100.0 * p_final * ({X.W_IMPACT} * impact + {X.W_EXPLOIT} * exploitability + {X.W_TARGET} * targeting) AS base_exact FROM (
      SELECT v.*, m.r_mult, greatest(0.0, least(1.0, coalesce(d.impact, {X.DEFAULT_IMPACT}) * m.r_mult))::DOUBLE AS impact, {EXPLOIT} AS exploitability, {TARGET} AS targeting,
        (CASE WHEN i.message_id IS NOT NULL THEN {X.ESC_IOC} ELSE 0 END
         + CASE WHEN f.hdr_brand_display_mismatch > 0 AND f.lex_authority_count > 0 THEN {X.ESC_EXEC} ELSE 0 END
         + CASE WHEN f.txt_thread_hijack_marker > 0 AND v.p_final >= 0.8 THEN {X.ESC_THREAD} ELSE 0 END)::DOUBLE AS escalation
      FROM {name}_v v JOIN {name}_m m USING (message_id) JOIN feat f USING (message_id) LEFT JOIN ioc_ids i USING (message_id)
      LEFT JOIN vector_dim d ON d.vector = v.vector)))""")


severity("sev", "fl")
severity("sev5", "fl5")
severity("sev0", "fl0", False)
