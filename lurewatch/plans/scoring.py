"""The scoring chain in order: features, model probability, prior, floors, votes, vector, severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.operators import enrich, history, scoring as SC
from lurewatch.operators.intent import IntentModel, predict_vectors, with_marks
from lurewatch.plans.features import with_features
from lurewatch.session import cut_lineage


def scored_rows(messages: DataFrame, banks=None, allowlist: tuple[str, ...] = ()) -> DataFrame:
    """A written table of feature rows with the marks the models read, without text."""
    return marked(with_features(messages, banks, allowlist, True))


def marked(features: DataFrame) -> DataFrame:
    """Feature rows with text as such a table."""
    return cut_lineage(with_marks(features).drop("body", "body_text"))


def with_state(feats: DataFrame, registry: DataFrame | None = None, mailbox_history: bool = False) -> DataFrame:
    """Join what the floors know beyond the message: domain age and mailbox history. Both are explicit; corpus work
    passes neither. The inputs are feature rows, so no message text is shuffled."""
    df = history.message_history(feats) if mailbox_history else history.no_history(feats)
    if registry is None:
        return df.withColumn("domain_age_days", F.lit(None).cast("int"))
    return enrich.domain_age(df, registry, F.to_date("sent_at"))


def ioc_hits(df: DataFrame, iocs: DataFrame) -> DataFrame:
    """Add ioc_hit: the sender or a link domain is on the known-bad list. Whether the list is broadcast is left to the
    engine's measure of it."""
    seen = df.select("message_id", F.explode(F.array_distinct(F.concat(
        F.array("registrable"), F.transform("urls", lambda u: u.registrable)))).alias("domain"))
    bad = seen.where("domain <> ''").join(iocs, "domain", "left_semi").select("message_id").distinct()
    return df.join(bad.withColumn("ioc_hit", F.lit(True)), "message_id", "left").withColumn(
        "ioc_hit", F.coalesce("ioc_hit", F.lit(False)))


def score(messages: DataFrame, p: Column | None = None, prior: float | None = None, registry: DataFrame | None = None,
          mailbox_history: bool = False, iocs: DataFrame | None = None, recipients: DataFrame | None = None,
          clf: tuple[str, str] | None = None, banks=None, allowlist: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """Messages to verdicts as one lazy plan, with a given probability (a column of the feature row) and vector guess."""
    df = with_features(messages, banks, allowlist, keep_text).withColumn("p_model", p)
    return score_rows(df, prior, registry, mailbox_history, iocs, recipients, clf)


def score_by(messages: DataFrame, model: IntentModel, vectors: tuple | None = None, **more) -> DataFrame:
    """Messages to verdicts by fitted models: feature rows are written once, and read by the models and by the score."""
    rows = scored_rows(messages)
    df = rows.join(model.predict(rows).withColumnRenamed("p", "p_model"), "message_id")
    if vectors is not None:
        df = df.join(predict_vectors(rows, *vectors), "message_id")
    return score_rows(df.drop("words", "shape"), clf=("clf_vector", "clf_p") if vectors is not None else None, **more)


def score_rows(df: DataFrame, prior: float | None = None, registry: DataFrame | None = None, mailbox_history: bool = False, iocs: DataFrame | None = None,
               recipients: DataFrame | None = None, clf: tuple[str, str] | None = None) -> DataFrame:
    """Feature rows with p_model to verdicts. The prior comes before the floors: a floor's minimum already is a
    deployment figure and must not be discounted again."""
    df = with_state(df, registry, mailbox_history)
    df = df.withColumn("p_prior", SC.prior_adjust(F.col("p_model"), prior))
    df = SC.apply_floors(SC.with_floors(df), "p_prior")
    df = SC.with_vote_result(SC.with_votes(df))
    df = SC.resolve_vector(df, "p_final", *(clf or (None, None)))
    hit = None
    if iocs is not None:
        df = ioc_hits(df, iocs)
        hit = F.col("ioc_hit")
    mult = None
    if recipients is not None:
        from lurewatch.operators.recipient import with_multiplier
        df = with_multiplier(df, recipients)
        mult = F.col("r_mult")
    df = SC.with_severity(df, "p_final", "vector", hit, mult)
    return df.withColumns({
        "verdict": SC.verdict(F.col("p_final")),
        "decided_by": F.when(F.size("binding") > 0, F.lit("deterministic rule")).otherwise(F.lit("model")),
    })
