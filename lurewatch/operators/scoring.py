"""Floors, votes, vectors, severity: columns over the feature row. Row-local, so no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.common import fence, string_map
from lurewatch.rules import taxonomy as X
from lurewatch.rules.floors import FLOORS
from lurewatch.rules.votes import VOTES

FLOOR_TYPE = "array<struct<name:string,minimum:double,ord:int,vector:string,why:string>>"
VECTOR_ORDER = {v: i for i, v in enumerate(X.VECTOR_KEYS)}
RULE_AUTHORITY, CONFIDENCE_FLOOR = 1.8, 0.55


def prior_adjust(p: Column, prior: float | None, train: float = X.TRAIN_PRIOR) -> Column:
    """The probability under another base rate (Bayes on the odds); unchanged when the prior is not inside (0, 1)."""
    if prior is None or not 0 < prior < 1:
        return p

    def odds(x):
        x = F.greatest(F.least(x, F.lit(1.0 - X.ODDS_EPS)), F.lit(X.ODDS_EPS))
        return x / (1.0 - x)

    o = odds(p) / (train / (1.0 - train)) * (prior / (1.0 - prior))
    return o / (1.0 + o)


def with_floors(df: DataFrame, floors=FLOORS) -> DataFrame:
    """Add `floors`: every floor whose predicate holds, in table order."""
    rows = ", ".join(
        f"CASE WHEN {f.when} THEN named_struct('name', '{f.name}', 'minimum', CAST({f.minimum} AS DOUBLE), 'ord', {i}, "
        f"'vector', {'NULL' if f.vector is None else repr(f.vector)}, 'why', {F_repr(f.why)}) END"
        for i, f in enumerate(floors))
    return fence(df.withColumn("floors", F.expr(f"CAST(filter(array({rows}), x -> x IS NOT NULL) AS {FLOOR_TYPE})")), "floors")


def F_repr(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def apply_floors(df: DataFrame, p: str, out: str = "p_final") -> DataFrame:
    """p lifted to the highest floor above it; `binding` holds only the floors above p."""
    df = df.withColumn("binding", F.filter("floors", lambda f: f.minimum > F.col(p)))
    top = F.coalesce(F.array_max(F.transform("binding", lambda f: f.minimum)), F.lit(0.0))
    return fence(df.withColumn(out, F.greatest(F.col(p), top)), out)


def floor_vector(binding: Column) -> Column:
    """struct(vector, name) of the highest binding floor that names a vector; the earlier row wins a tie."""
    ranked = F.transform(F.filter(binding, lambda f: f["vector"].isNotNull()), lambda f: F.struct(
        (-f.minimum).alias("k"), f.ord.alias("ord"), f.vector.alias("vector"), f["name"].alias("name")))
    return F.array_min(ranked)


def with_votes(df: DataFrame, votes=VOTES) -> DataFrame:
    """Add `votes`: one entry per labelling function that does not abstain."""
    rows = ", ".join(
        f"CASE WHEN {v.when} THEN named_struct('lf', '{v.lf}', 'vector', '{v.vector}', 'weight', CAST({v.weight} AS DOUBLE)) END"
        for v in votes)
    return fence(df.withColumn("votes", F.expr(f"filter(array({rows}), x -> x IS NOT NULL)")), "votes")


def with_vote_result(df: DataFrame) -> DataFrame:
    """Add rule_vector, rule_confidence, rule_weight (largest total) and runner_up_weight."""
    keys = F.array_distinct(F.transform("votes", lambda v: v.vector))
    order = string_map((k, str(i)) for k, i in VECTOR_ORDER.items())
    totals = F.transform(keys, lambda k: F.struct(
        (-F.aggregate(F.filter("votes", lambda v: v.vector == k), F.lit(0.0), lambda a, v: a + v.weight)).alias("neg"),
        F.element_at(order, k).cast("int").alias("ord"), k.alias("vector")))
    df = fence(df.withColumn("_totals", F.array_sort(totals)), "_totals")
    df = df.withColumns({
        "rule_weight": F.round(-F.coalesce(F.get("_totals", F.lit(0)).neg, F.lit(0.0)), 6),
        "runner_up_weight": F.round(-F.coalesce(F.get("_totals", F.lit(1)).neg, F.lit(0.0)), 6),
        "total_weight": F.round(-F.aggregate("_totals", F.lit(0.0), lambda a, t: a + t.neg), 6),
        "_top": F.get("_totals", F.lit(0)).vector,
    })
    top, second, total = F.col("rule_weight"), F.col("runner_up_weight"), F.col("total_weight")
    decided = top >= 1.0
    conf = F.round(F.least(F.lit(1.0), top / total * (0.55 + 0.45 * (top - second) / top)), 4)
    df = df.withColumns({
        "rule_vector": F.when(decided, F.col("_top")).otherwise(F.lit("malicious_unclassified")),
        "rule_confidence": F.when(decided, conf).otherwise(F.lit(0.0)),
    }).drop("_totals", "_top")
    return fence(df, "rule_vector")


def resolve_vector(df: DataFrame, p: str = "p_final", clf_vector: str | None = None, clf_p: str | None = None) -> DataFrame:
    """Rules with enough weight win, then the classifier, then weak rules; a binding floor's vector overrides all but a
    heavy rule. Adds vector, vector_confidence, vector_source."""
    implied = floor_vector(F.col("binding"))
    df = df.withColumn("_implied", implied)
    named = F.col("rule_vector") != "malicious_unclassified"
    by_rule = F.least(F.lit(1.0), F.col("rule_weight") / 4.0)
    benign = F.col(p) < 0.5
    if clf_vector is None:
        vec, conf, src = F.col("rule_vector"), F.col("rule_confidence"), F.lit("rule")
    else:
        strong = named & (F.col("rule_weight") >= RULE_AUTHORITY)
        sure = F.col(clf_p) >= CONFIDENCE_FLOOR
        vec = F.when(strong, F.col("rule_vector")).when(sure, F.col(clf_vector)).when(named, F.col("rule_vector")).otherwise(
            F.lit("malicious_unclassified"))
        conf = F.when(strong, by_rule).when(sure, F.col(clf_p)).when(named, by_rule).otherwise(F.col(clf_p))
        src = F.when(strong, F.lit("rule")).when(sure, F.lit("classifier")).when(named, F.lit("rule (weak)")).otherwise(F.lit("unresolved"))
        lifted = F.col("_implied").isNotNull() & ((src != "rule") | (F.col("rule_weight") < 2.5))
        vec = F.when(lifted, F.col("_implied.vector")).otherwise(vec)
        conf = F.when(lifted, F.lit(0.9)).otherwise(conf)
        src = F.when(lifted, F.concat(F.lit("floor "), F.col("_implied.name"))).otherwise(src)
    df = df.withColumns({
        "vector": F.when(benign, F.lit("benign")).otherwise(vec),
        "vector_confidence": F.when(benign, F.lit(1.0)).otherwise(conf),
        "vector_source": F.when(benign, F.lit("intent model")).otherwise(src),
    }).drop("_implied")
    return fence(df, "vector")


def impact_of(vector: Column) -> Column:
    table = F.expr("map(" + ", ".join(f"'{k}', {imp}D" for k, _, imp, _ in X.VECTORS) + ")")
    return F.coalesce(F.element_at(table, vector), F.lit(X.DEFAULT_IMPACT))


def weighted(signals) -> Column:
    """Sum of the weights of the features above zero, capped at 1."""
    return F.expr("least(1.0D, " + " + ".join(f"IF({n} > 0, {w}D, 0.0D)" for n, w in signals) + ")")


def exploitability() -> Column:
    return weighted(X.EXPLOIT_WEIGHTS)


def targeting() -> Column:
    bulk = (F.col("hdr_recipient_undisclosed") > 0) | (F.col("lex_spam_bulk_marker_count") >= 2)
    return weighted(X.TARGET_WEIGHTS) * F.when(bulk, F.lit(0.4)).otherwise(F.lit(1.0))


def band_of(score: Column) -> Column:
    out = F.lit("INFORMATIONAL")
    for floor, name in reversed(X.BANDS):
        out = F.when(score >= floor, F.lit(name)).otherwise(out)
    return out


def band_rank(band: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, r in X.BAND_RANK.items():
        out = F.when(band == name, F.lit(r)).otherwise(out)
    return out


def with_severity(df: DataFrame, intent: str = "p_final", vector: str = "vector", ioc: Column | None = None,
                  recipient_mult: Column | None = None) -> DataFrame:
    """Add impact, exploitability, targeting, base_score, escalation, severity (1 dp) and band (from the exact total)."""
    mult = recipient_mult if recipient_mult is not None else F.lit(1.0)
    hit = ioc if ioc is not None else F.lit(False)
    df = df.withColumns({
        "base_impact": impact_of(F.col(vector)), "recipient_mult": mult, "exploitability": exploitability(), "targeting": targeting()})
    df = df.withColumn("impact", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("base_impact") * F.col("recipient_mult"))))
    base = 100.0 * F.col(intent) * (X.W_IMPACT * F.col("impact") + X.W_EXPLOIT * F.col("exploitability") + X.W_TARGET * F.col("targeting"))
    esc = (
        F.when(hit, F.lit(X.ESC_IOC)).otherwise(F.lit(0.0))
        + F.when((F.col("hdr_brand_display_mismatch") > 0) & (F.col("lex_authority_count") > 0), F.lit(X.ESC_EXEC)).otherwise(F.lit(0.0))
        + F.when((F.col("txt_thread_hijack_marker") > 0) & (F.col(intent) >= 0.8), F.lit(X.ESC_THREAD)).otherwise(F.lit(0.0)))
    df = df.withColumns({"base_exact": base, "escalation": esc})
    total = F.least(F.lit(100.0), F.col("base_exact") + F.col("escalation"))
    df = df.withColumns({
        "band": band_of(total), "severity": F.round(F.round(total, 6), 1), "base_score": F.round(F.round("base_exact", 6), 1),
    }).drop("base_exact")
    return fence(df, "band")


def arithmetic() -> Column:
    """The severity formula with this row's numbers in it."""
    shown = F.when(F.col("recipient_mult") == 1.0, F.format_string("%.2f", "impact")).otherwise(
        F.format_string("(%.2f x %.2f)", "base_impact", "recipient_mult"))
    head = F.format_string("100 x %.3f x (0.5 x %s + 0.3 x %.2f + 0.2 x %.2f) = %.1f", "p_final", shown, "exploitability",
                           "targeting", "base_score")
    tail = F.when(F.col("escalation") != 0, F.format_string(" + %.0f = %.1f", "escalation", "severity")).otherwise(F.lit(""))
    return F.concat(head, tail)


def verdict(p: Column) -> Column:
    return F.when(p >= 0.5, F.lit("MALICIOUS")).when(p >= 0.2, F.lit("SUSPICIOUS")).otherwise(F.lit("BENIGN"))


def action_policy(df: DataFrame, action: str = "none", threshold: float = 70.0, require_rule: bool = True) -> DataFrame:
    """Add act and reason. Nothing is ever performed here; a dry run is the default everywhere."""
    if action not in ("flag", "quarantine", "trash"):
        return df.withColumns({"act": F.lit(False), "reason": F.lit("auto-action disabled")})
    low = F.col("severity") < threshold
    no_rule = (F.size("binding") == 0) if require_rule else F.lit(False)
    benign = F.col("vector") == "benign"
    first = F.get("binding", F.lit(0)).getField("name")
    reason = (
        F.when(low, F.format_string(f"severity %.1f below threshold {threshold:g}", "severity"))
        .when(no_rule, F.lit("no deterministic rule fired"))
        .when(benign, F.lit("vector is benign"))
        .otherwise(F.concat(F.format_string(f"severity %.1f >= {threshold:g}", "severity"),
                            F.when(first.isNotNull(), F.concat(F.lit(", rule "), first)).otherwise(F.lit("")))))
    return df.withColumns({"act": ~(low | no_rule | benign), "reason": reason})
