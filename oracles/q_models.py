"""Oracle SQL of explanations, evaluation and learner analytics (fitted models have none)."""

from __future__ import annotations

from lurewatch.operators import explain as EX
from lurewatch.operators.learner import TACTICS
from lurewatch.rules.lexicons import BANK_NAMES, BANK_TACTIC, TELL_BANKS
from oracles.base import cte, lst, q, rows
from oracles.q_corpus import bucket
from oracles.q_scoring import TACTIC_ROWS

ORACLE: dict[str, str] = {}
cte("tfidf", ("messages",), """
WITH t AS (SELECT message_id, token, count(*) AS tf FROM (SELECT message_id, unnest(regexp_extract_all(lower(subject || ' ' || body), '[a-z0-9'']{2,}')) AS token FROM messages) GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM messages),
d AS (SELECT token, count(*) AS df FROM t GROUP BY 1 HAVING count(*) >= 3 AND count(*) <= 0.6 * (SELECT n FROM n)),
r AS (SELECT message_id, token, (1 + ln(tf)) * (ln(((SELECT n FROM n) + 1) / (df + 1)) + 1) AS w FROM t JOIN d USING (token))
SELECT message_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY message_id)) AS tfidf FROM r""")
ORACLE["ml_tfidf"] = q("SELECT message_id, count(*) AS terms, round(sum(tfidf), 4) AS mass, round(max(tfidf), 4) AS top FROM tfidf GROUP BY 1", "tfidf")
ORACLE["ml_char_ngrams"] = q("""SELECT gram, count(*) AS df FROM (SELECT DISTINCT message_id, substr(w, i, n) AS gram FROM (
  SELECT message_id, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM (SELECT message_id, w, unnest([3, 4, 5]) AS n FROM (
    SELECT message_id, ' ' || unnest(list_filter(string_split_regex(lower(subject || ' ' || body), '\\s+'), lambda x: x <> '')) || ' ' AS w FROM messages)) WHERE length(w) >= n)) GROUP BY 1 HAVING count(*) >= 4""", "messages")
ORACLE["ex_token_contrib"] = q("""SELECT message_id, token, round(c, 4) AS contribution, rank FROM (SELECT message_id, token, tfidf * weight AS c,
  row_number() OVER (PARTITION BY message_id ORDER BY abs(tfidf * weight) DESC, token) AS rank FROM tfidf JOIN token_weights USING (token)) WHERE rank <= 15""", "tfidf", "token_weights")
ORACLE["ex_view_share"] = q("""SELECT message_id, round(a / t, 6) AS structural, round(b / t, 6) AS wording FROM (SELECT *, CASE WHEN a + b > 0 THEN a + b ELSE 1 END AS t FROM (
  SELECT message_id, abs(0.8 * ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6)))) AS a, abs(1.7 * (p - 0.5)) AS b FROM scored))""", "scored")
_Z = f"({EX.INTERCEPT} + " + " + ".join(f"{w} * {n}" for n, w in EX.LINEAR.items()) + ")::DOUBLE"
_LONG = " UNION ALL ".join(f"SELECT message_id, '{n}' AS feature, {i} AS ord, {n} AS value, {w} * ({n} - avg({n}) OVER ()) AS contribution, {_Z} AS z, {w} AS w FROM feat" for i, (n, w) in enumerate(EX.LINEAR.items()))
cte("att", ("feat",), _LONG)
ORACLE["ex_counterfactual"] = q("""SELECT message_id, feature, round(1 / (1 + exp(-z)), 6) AS p, round(1 / (1 + exp(-(z - w * value))), 6) AS p_without FROM (
  SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ord) AS rn FROM att WHERE value > 0) WHERE rn <= 6""", "att")
ORACLE["ex_linear_attribution"] = q("""SELECT message_id, round(sum(contribution), 6) AS total, round(any_value(z), 6) AS logit, true AS adds_up FROM att GROUP BY 1""", "att")
ORACLE["win_rank_attributions"] = q("""SELECT message_id, feature, round(contribution, 6) AS contribution, rank FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY abs(contribution) DESC, feature) AS rank FROM att) WHERE rank <= 5""", "att")

_AUC = """SELECT {k} sum(y) AS n_pos, sum(1 - y) AS n_neg, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM (
  SELECT {k} y, rank() OVER (PARTITION BY {p} ORDER BY p) + (count(*) OVER (PARTITION BY {p}, p) - 1) / 2.0 AS r FROM {s}) {g}"""
ORACLE["ev_roc_auc"] = q("SELECT CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, round(auc, 6) AS auc FROM (" + _AUC.format(k="", p="1", s="scored", g="") + ")", "scored")
ORACLE["ev_pr_auc"] = q("""SELECT round(sum(pos * tp / seen / allp), 6) AS average_precision FROM (SELECT p, pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(pos + neg) OVER (ORDER BY p DESC) AS seen, sum(pos) OVER () AS allp
  FROM (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY p))""", "scored")
ORACLE["ev_brier"] = q("SELECT round(avg(pow(p - y, 2)), 6) AS brier, count(*) AS n FROM scored", "scored")
_CF = "count(*) FILTER (p >= {t} AND y = 1) AS tp, count(*) FILTER (p >= {t} AND y = 0) AS fp, count(*) FILTER (p < {t} AND y = 1) AS fn, count(*) FILTER (p < {t} AND y = 0) AS tn"
_RT = "CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0.0 END AS recall, CASE WHEN fp + tn > 0 THEN round(fp / (fp + tn), 6) ELSE 0.0 END AS fpr"
ORACLE["ev_confusion"] = q(f"SELECT *, {_RT} FROM (SELECT {_CF.format(t=0.5)} FROM scored)", "scored")
ORACLE["ev_operating_points"] = q(f"SELECT *, {_RT} FROM (" + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, {_CF.format(t=t)} FROM scored" for t in (0.5, 0.7, 0.8, 0.9, 0.95, 0.99)) + ")", "scored")
ORACLE["ev_calibration_bins"] = q("SELECT CAST(floor(p * 10) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM scored WHERE p < 1 GROUP BY 1 HAVING count(*) >= 20", "scored")
ORACLE["ev_class_report"] = q("""
WITH s AS (SELECT b_vector AS cls, count(*) AS support, count(*) FILTER (a_vector = b_vector) AS tp FROM labellers GROUP BY 1), p AS (SELECT a_vector AS cls, count(*) AS predicted FROM labellers GROUP BY 1),
j AS (SELECT cls, coalesce(support, 0) AS support, coalesce(tp, 0) / nullif(predicted, 0) AS pr, coalesce(tp, 0) / nullif(support, 0) AS re FROM s FULL JOIN p USING (cls))
SELECT cls, support, round(coalesce(pr, 0), 6) AS precision, round(coalesce(re, 0), 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM j""", "labellers")
ORACLE["ev_bucket_accuracy"] = q("SELECT 'b' || (message_id % 4) AS bucket, count(*) AS n, round(avg((a_vector = b_vector)::INT), 6) AS accuracy FROM labellers GROUP BY 1", "labellers")
cte("loso", ("messages",), """
WITH t AS (SELECT DISTINCT message_id, source, label, token FROM (SELECT message_id, source, label, unnest(regexp_extract_all(lower(subject || ' ' || body), '[a-z]{3,}')) AS token FROM messages)),
p AS (SELECT source, token, sum(label) AS b, sum(1 - label) AS g FROM t GROUP BY 1, 2),
w AS (SELECT source, token, ln((sum(b) OVER (PARTITION BY token) - b + 1) / (sum(g) OVER (PARTITION BY token) - g + 1)) AS w FROM p)
SELECT source, label AS y, round(1 / (1 + exp(-z)), 6) AS p FROM (SELECT t.source, t.message_id, t.label, round(sum(w.w), 6) AS z FROM t JOIN w USING (source, token) GROUP BY 1, 2, 3)""")
ORACLE["ev_leave_one_source"] = q("SELECT source, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, round(auc, 6) AS auc FROM (" + _AUC.format(k="source,", p="source", s="loso", g="GROUP BY source HAVING sum(y) > 0 AND sum(1 - y) > 0") + ")", "loso")
ORACLE["ev_ood_recall"] = q(f"SELECT CASE WHEN {bucket('source')} < 25 THEN 'excluded' ELSE 'included' END AS grp, count(*) FILTER (y = 1) AS n, round(avg((p >= 0.6)::INT) FILTER (y = 1), 6) AS recall FROM scored GROUP BY 1", "scored")
ORACLE["ev_probe"] = q("""SELECT kind, count(*) AS n, round(avg((p_final >= 0.5)::INT), 4) AS flagged, count(DISTINCT vector) AS vectors, round(avg(severity), 4) AS mean_severity
FROM sev JOIN (SELECT message_id, kind FROM messages) USING (message_id) GROUP BY 1""", "sev", "messages")
ORACLE["ev_language_fp"] = q("SELECT lang, lang_detected, count(*) AS n FROM documents JOIN doc_lang USING (doc_id) GROUP BY 1, 2", "doc_lang")

cte("tactic_scores", ("answers",), "SELECT learner, tactic, count(*) AS seen, sum(correct)::BIGINT AS correct, sum(correct) / count(*) AS accuracy, count(*) >= 4 AS settled FROM answers GROUP BY 1, 2")
ORACLE["agg_learner"] = q("""
WITH l AS (SELECT learner, sum(seen)::BIGINT AS answered, CASE WHEN sum(seen) < 8 OR sum(correct) / sum(seen) < 0.70 THEN 'noticing' WHEN sum(correct) / sum(seen) < 0.88 THEN 'checking' ELSE 'reasoning' END AS level FROM tactic_scores GROUP BY 1)
SELECT learner, tactic, seen, correct, round(accuracy, 6) AS accuracy, settled, level, answered FROM tactic_scores JOIN l USING (learner)""", "tactic_scores")
ORACLE["win_streak"] = q("""
WITH r AS (SELECT *, sum(1 - correct) OVER (PARTITION BY learner ORDER BY answered_at, answer_id) AS grp FROM answers),
g AS (SELECT learner, grp, sum(correct)::BIGINT AS run FROM r GROUP BY 1, 2)
SELECT learner, arg_max(run, grp) AS streak, max(run) AS best_streak FROM g GROUP BY 1""", "answers")
cte("tactic_dim", (), rows("ord, tactic", enumerate(TACTICS)))
cte("weak", ("tactic_scores", "tactic_dim"), """
SELECT learner, tactic, row_number() OVER (PARTITION BY learner ORDER BY (coalesce(seen, 0) > 0)::INT, coalesce(accuracy, 0), ord) AS rank FROM (
  SELECT l.learner, d.tactic, d.ord, s.seen, s.accuracy, s.settled FROM (SELECT DISTINCT learner FROM tactic_scores) l CROSS JOIN tactic_dim d LEFT JOIN tactic_scores s ON s.learner = l.learner AND s.tactic = d.tactic)
WHERE coalesce(seen, 0) = 0 OR (settled AND accuracy < 0.75)""")
ORACLE["win_weak_tactics"] = q("""SELECT learner, 'focus' AS kind, rank, tactic FROM weak WHERE rank <= 3
UNION ALL SELECT learner, 'strength', rank, tactic FROM (SELECT s.learner, s.tactic, row_number() OVER (PARTITION BY s.learner ORDER BY accuracy DESC, d.ord) AS rank
  FROM tactic_scores s JOIN tactic_dim d USING (tactic) WHERE settled AND accuracy >= 0.85) WHERE rank <= 3""", "weak", "tactic_scores", "tactic_dim")
ORACLE["lrn_target"] = q(f"""
WITH a AS ({TACTIC_ROWS}), j AS (SELECT n.learner, a.message_id, a.tactic, w.rank FROM answers n JOIN a ON a.message_id = n.answer_id JOIN weak w ON w.learner = n.learner AND w.tactic = a.tactic WHERE w.rank <= 5)
SELECT learner, message_id, tactic, row_number() OVER (PARTITION BY learner, message_id ORDER BY rank) AS pos, count(*) OVER (PARTITION BY learner, message_id) AS targets,
  least(count(*) OVER (PARTITION BY learner, message_id), 2) AS required FROM j""", "feat", "answers", "weak")
_BT = rows("lexicon, tactic", BANK_TACTIC.items())
_BO = rows("lexicon, bank_ord", [(n, i) for i, n in enumerate(BANK_NAMES)])
cte("item_spans", ("hits",), f"""SELECT * FROM (SELECT h.message_id, h.lexicon, h.span_start, h.span_end, t.tactic, row_number() OVER (PARTITION BY h.message_id ORDER BY b.bank_ord, h.i) AS rn
FROM hits h JOIN ({_BO}) b USING (lexicon) LEFT JOIN ({_BT}) t USING (lexicon) WHERE h.field = 'body' AND h.lexicon IN {lst(TELL_BANKS)}) WHERE rn <= 12""")
ORACLE["lrn_grade"] = q("""
WITH a AS (SELECT n.answer_id AS item_id, n.correct = 1 AS said, CASE WHEN n.answer_id % 2 = 0 THEN (n.answer_id * 7) % 120 END AS click, m.label FROM answers n JOIN messages m ON m.message_id = n.answer_id),
h AS (SELECT a.item_id, arg_min(coalesce(s.tactic, 'pretext'), s.rn) AS tactic FROM a JOIN item_spans s ON s.message_id = a.item_id WHERE a.click BETWEEN s.span_start - 12 AND s.span_end + 12 GROUP BY 1),
f AS (SELECT message_id, arg_min(tactic, rn) AS tactic FROM item_spans WHERE tactic IS NOT NULL GROUP BY 1)
SELECT a.item_id, CASE WHEN click IS NOT NULL THEN h.item_id IS NOT NULL ELSE (label = 1) = said END AS graded_right, coalesce(h.tactic, f.tactic, 'pretext') AS credited
FROM a LEFT JOIN h USING (item_id) LEFT JOIN f ON f.message_id = a.item_id""", "answers", "messages", "item_spans")
