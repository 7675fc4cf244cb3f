"""Oracle CTEs of the fitted models in the score: intent (message_id, p) and clf (message_id, clf_vector, clf_p)."""

from __future__ import annotations

from lurewatch.operators.intent import FOLDS, KNOTS, MIN_MESSAGES, PLACE, SCALE, STRUCTURE, SURE, VECTORS, Z
from oracles.base import cte, lst, s

_SHAPE = "[" + ", ".join(f"CASE WHEN {n} > 0 THEN '{n}' END" for n in STRUCTURE) + "]"
cte("im_rows", ("messages",), f"SELECT message_id, label, subject, body, ('0x' || left(md5(subject || chr(10) || body), 8))::BIGINT % {FOLDS} AS fold FROM messages")
cte("im_marks", ("im_rows", "feat"), f"""
SELECT message_id, label, fold, 'wording' AS view, unnest(list_distinct(regexp_extract_all(lower(subject || ' ' || body), '[a-z]{{3,}}'))) AS mark FROM im_rows
UNION ALL
SELECT r.message_id, r.label, r.fold, 'structure', mark FROM im_rows r JOIN (SELECT message_id, unnest(list_filter({_SHAPE}, lambda x: x IS NOT NULL)) AS mark FROM feat) USING (message_id)""")
cte("folds", (), f"SELECT unnest(range({FOLDS})) AS own")


def weights(inside: str, n_in: str, outside: str, n_out: str) -> str:
    apart, held, n = f"({inside}::DOUBLE * {n_out} - {outside}::DOUBLE * {n_in})", f"({inside} + {outside})::DOUBLE", f"({n_in} + {n_out})::DOUBLE"
    return (f"ln(({inside} + 0.5::DOUBLE) / ({n_in} + 1.0::DOUBLE)) - ln(({outside} + 0.5::DOUBLE) / ({n_out} + 1.0::DOUBLE)) AS w, "
            f"{apart} <> 0 AND {apart} * {apart} * {n} >= {Z * Z}::DOUBLE * {held} * ({n} - {held}) * {n_in} * {n_out} AS sure")


cte("im_weights", ("im_marks", "im_rows", "folds"), f"""
SELECT own AS fold, view, mark, CAST(round(w * {SCALE}) AS BIGINT) AS weight FROM (
  SELECT *, {weights('inside', 'n1', 'outside', 'n0')} FROM (
    SELECT own, view, mark, count(*) FILTER (fold <> own AND label = 1) AS inside, count(*) FILTER (fold <> own AND label = 0) AS outside FROM im_marks, folds GROUP BY 1, 2, 3)
  JOIN (SELECT own, count(*) FILTER (fold <> own AND label = 1) AS n1, count(*) FILTER (fold <> own AND label = 0) AS n0 FROM im_rows, folds GROUP BY 1) USING (own))
WHERE inside + outside >= {MIN_MESSAGES} AND sure""")
cte("im_z", ("im_rows", "im_marks", "im_weights"), f"""
SELECT message_id, r.label, r.fold, CAST(round(coalesce(sum(weight) FILTER (view = 'wording'), 0) / {SCALE // PLACE}.0::DOUBLE) AS BIGINT) AS x,
  CAST(round(coalesce(sum(weight) FILTER (view = 'structure'), 0) / {SCALE // PLACE}.0::DOUBLE) AS BIGINT) AS y
FROM im_rows r LEFT JOIN (SELECT m.message_id, m.view, weight FROM im_marks m JOIN im_weights w ON w.fold = m.fold AND w.view = m.view AND w.mark = m.mark) USING (message_id) GROUP BY 1, 2, 3""")
_S = {c: [f"sum({e}) FILTER (label = {v} AND fold <> own)::DOUBLE AS {c}{i}" for i, e in enumerate(("1", "x", "y", "x * x", "y * y", "x * y"))] for c, v in (("a", 1), ("b", 0))}


def _pooled(k: int, i: int, j: int) -> str:
    part = [f"({c}{k} / {PLACE} / {PLACE} - {c}0 * {c}m{i} * {c}m{j})" for c in "ba"]
    return f"({part[0]} + {part[1]}) / (a0 + b0 - 2)"


cte("im_abc", ("im_z", "folds"), f"""
SELECT own, CASE WHEN few THEN 1.0 ELSE a END AS a, CASE WHEN few THEN 1.0 ELSE b END AS b, CASE WHEN few THEN 0.0 ELSE ln(a0 / b0) - 0.5 * (a * (bm0 + am0) + b * (bm1 + am1)) END AS c FROM (
  SELECT *, (yy * dx - xy * dy) / (xx * yy - xy * xy) AS a, (xx * dy - xy * dx) / (xx * yy - xy * xy) AS b FROM (
    SELECT *, {_pooled(3, 0, 0)} + 0.01 AS xx, {_pooled(4, 1, 1)} + 0.01 AS yy, {_pooled(5, 0, 1)} AS xy, am0 - bm0 AS dx, am1 - bm1 AS dy, coalesce(least(a0, b0), 0) < 2 AS few FROM (
      SELECT *, a1 / a0 / {PLACE} AS am0, a2 / a0 / {PLACE} AS am1, b1 / b0 / {PLACE} AS bm0, b2 / b0 / {PLACE} AS bm1 FROM (
        SELECT own, {', '.join(_S['a'] + _S['b'])} FROM im_z, folds GROUP BY own))))""")
cte("im_s", ("im_z", "im_abc"), f"""
SELECT *, CAST(round((s - lo) * {PLACE}) AS BIGINT) AS share FROM (SELECT *, CAST(floor(s) AS BIGINT) AS lo FROM (
  SELECT z.message_id, z.label, z.fold, round(greatest(-{KNOTS}.0, least({KNOTS - 0.001}, a * (x / {PLACE}.0::DOUBLE) + b * (y / {PLACE}.0::DOUBLE) + c)), 3) AS s FROM im_z z JOIN im_abc ON own = fold))""")
cte("im_knots", ("im_s", "folds"), f"""
SELECT own, k, coalesce(max(CASE WHEN n > 0 THEN (hits + {0.5 * PLACE}) / (n + {PLACE}) END) OVER (PARTITION BY own ORDER BY k), 0)::DOUBLE AS rate FROM (
  SELECT own, k, coalesce(sum(e.n) FILTER (e.fold <> own), 0)::DOUBLE AS n, coalesce(sum(e.n * e.label) FILTER (e.fold <> own), 0)::DOUBLE AS hits
  FROM folds, (SELECT unnest(range(-{KNOTS}, {KNOTS + 1})) AS k) LEFT JOIN (
    SELECT fold, label, lo AS at, {PLACE} - share AS n FROM im_s UNION ALL SELECT fold, label, lo + 1, share FROM im_s) e ON e.at = k GROUP BY 1, 2)""")
cte("intent", ("im_s", "im_knots"), f"""
SELECT message_id, round(a.rate * (1 - share / {PLACE}.0::DOUBLE) + b.rate * (share / {PLACE}.0::DOUBLE), 6) AS p
FROM im_s s JOIN im_knots a ON a.own = s.fold AND a.k = s.lo JOIN im_knots b ON b.own = s.fold AND b.k = s.lo + 1""")

# ---- vectors
cte("vc_sure", ("im_rows", "resolved"), f"""
SELECT message_id, fold, rule_vector AS cls FROM im_rows JOIN (SELECT message_id, rule_vector, rule_confidence FROM resolved) USING (message_id)
WHERE label = 1 AND rule_confidence >= {SURE} AND rule_vector IN {lst(VECTORS)}""")
cte("vc_classes", (), "SELECT * FROM (VALUES " + ", ".join(f"({i}, {s(v)})" for i, v in enumerate(VECTORS)) + ") AS t(i, cls)")
cte("vc_totals", ("vc_sure", "vc_classes", "folds"), """
SELECT own, i, c.cls, count(*) FILTER (r.fold <> own AND r.cls = c.cls) AS n_in, count(*) FILTER (r.fold <> own AND r.cls <> c.cls) AS n_out
FROM folds CROSS JOIN vc_classes c LEFT JOIN vc_sure r ON true GROUP BY 1, 2, 3""")
cte("vc_weights", ("vc_sure", "im_marks", "vc_totals"), f"""
SELECT own AS fold, view, mark, cls, CAST(round(w * {SCALE}) AS BIGINT) AS weight FROM (
  SELECT *, {weights('inside', 'n_in', 'outside', 'n_out')} FROM (
    SELECT t.own, t.cls, t.n_in, t.n_out, m.view, m.mark, count(*) FILTER (r.fold <> own AND r.cls = t.cls) AS inside, count(*) FILTER (r.fold <> own AND r.cls <> t.cls) AS outside
    FROM vc_sure r JOIN im_marks m USING (message_id) CROSS JOIN vc_totals t GROUP BY ALL))
WHERE inside + outside >= {MIN_MESSAGES} AND sure""")
cte("clf", ("im_rows", "im_marks", "vc_weights", "vc_totals"), f"""
SELECT message_id, arg_min(cls, (neg, i)) AS clf_vector, round(1.0 / sum(exp(low - neg)), 6) AS clf_p FROM (SELECT *, min(neg) OVER (PARTITION BY message_id) AS low FROM (
  SELECT r.message_id, t.i, t.cls, -round((round({SCALE} * ln((n_in + 1.0::DOUBLE) / (n_out + 1.0::DOUBLE))) + coalesce(h.w, 0)) / {SCALE}.0::DOUBLE / sqrt(greatest(1, coalesce(h.n, 0))), 6) AS neg
  FROM im_rows r JOIN vc_totals t ON t.own = r.fold LEFT JOIN (
    SELECT m.message_id, w.cls, sum(weight)::DOUBLE AS w, count(*) AS n FROM im_marks m JOIN vc_weights w ON w.fold = m.fold AND w.view = m.view AND w.mark = m.mark GROUP BY 1, 2) h
  ON h.message_id = r.message_id AND h.cls = t.cls)) GROUP BY 1""")
