"""Registered queries: models, explanations, evaluation and learner analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lurewatch.functions.common import extract_all
from lurewatch.functions.language import with_language
from lurewatch.operators import evaluate as EV
from lurewatch.operators import explain as EX
from lurewatch.operators import learner as LN
from lurewatch.operators import models as M
from lurewatch.operators.sampling import calibration_slice, group_split, hash_bucket
from lurewatch.operators.scoring import with_vote_result, with_votes
from lurewatch.plans.features import feature_names, prepare, with_features
from lurewatch.plans.q_corpus import pool
from lurewatch.plans.q_features import featured, messages, rounded
from lurewatch.plans.views import table, view
from lurewatch.session import cut_lineage

QUERIES = {}
MIN_DF, MAX_DF = 3, 0.6


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tfidf(spark, d):
    """(message_id, token, tfidf): sublinear tf, smoothed idf + 1, L2 norm, document-frequency bounds."""
    toks = messages(spark, d).select("message_id", F.explode(extract_all(F.lower(F.concat("subject", F.lit(" "), "body")), r"[a-z0-9']{2,}")).alias("token"))
    tf = toks.groupBy("message_id", "token").agg(F.count("*").alias("tf"))
    n = messages(spark, d).select("message_id").count()
    df = tf.groupBy("token").agg(F.count("*").alias("df")).where((F.col("df") >= MIN_DF) & (F.col("df") <= MAX_DF * n))
    raw = tf.join(df, "token").select("message_id", "token", ((1 + F.log("tf")) * (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1)).alias("w"))
    norm = raw.groupBy("message_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "message_id").select("message_id", "token", (F.col("w") / F.col("norm")).alias("tfidf"))


@query
def ml_tfidf(spark, d):
    out = tfidf(spark, d).groupBy("message_id").agg(F.count("*").alias("terms"), F.sum("tfidf").alias("mass"), F.max("tfidf").alias("top"))
    return rounded(out, 4)


@query
def ml_char_ngrams(spark, d):
    """Word-bounded character 3-5-grams with document frequency four or more."""
    whole = messages(spark, d).select("message_id", F.array_distinct(M.char_grams(F.concat("subject", F.lit(" "), "body"))).alias("g"))
    return whole.select("message_id", F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).where("df >= 4")


@query
def ex_token_contrib(spark, d):
    return rounded(EX.token_contributions(tfidf(spark, d), view(spark, d, "token_weights")).withColumn("rank", F.col("rank").cast("bigint")), 4)


def candidates(spark, d):
    return featured(spark, d).select("message_id", *EX.CANDIDATES)


@query
def ex_view_share(spark, d):
    s = view(spark, d, "scored")
    a, b = EX.view_share(M.logit(F.col("p")), F.col("p") - 0.5, 0.8, 1.7)
    return rounded(s.select("message_id", a.alias("structural"), b.alias("wording")))


@query
def ex_counterfactual(spark, d):
    return rounded(EX.counterfactuals(candidates(spark, d)))


def means(df):
    """Column means; one row of twelve numbers reaches the driver."""
    return df.agg(*[F.avg(n).alias(n) for n in EX.CANDIDATES]).first().asDict()


def attributed(spark, d):
    df = candidates(spark, d)
    return EX.attributions(df, means(df))


@query
def ex_linear_attribution(spark, d):
    """Contributions add up to the score minus the mean score."""
    df = candidates(spark, d)
    mean = means(df)
    base = EX.INTERCEPT + sum(w * mean[n] for n, w in EX.LINEAR.items())
    total = EX.attributions(df, mean).groupBy("message_id").agg(F.sum("contribution").alias("total"))
    out = total.join(df.select("message_id", EX.linear_logit().alias("logit")), "message_id")
    return rounded(out.select("message_id", "total", "logit", (F.abs(F.col("total") - (F.col("logit") - base)) < 1e-9).alias("adds_up")))


@query
def win_rank_attributions(spark, d):
    return rounded(EX.ranked(attributed(spark, d), 5).select("message_id", "feature", "contribution", F.col("rank").cast("bigint").alias("rank")))


@query
def ex_findings(spark, d):
    return EX.findings(attributed(spark, d))


def training(spark, d):
    """Feature rows with split and text, written once for the model fits."""
    df = with_features(messages(spark, d), keep_text=True).withColumn("text", F.concat("subject", F.lit(" "), "body_text"))
    df = calibration_slice(group_split(df, F.col("message_id")), F.col("message_id"))
    return cut_lineage(df.select("message_id", "label", "split", "text", "authenticated", *feature_names()))


STRUCT = list(feature_names())


def wording(df):
    """(rows, model): the counts of every row's words and character n-grams, written once, and the model fitted on those of
    the train split. The vocabulary is that of the train split."""
    texts = M.with_char_grams(df.select("message_id", "label", "split", "text"), "text")
    counts = M.wording_counts().fit(texts.where("split = 'train'")).transform(texts)
    rows = cut_lineage(counts.select("message_id", "label", "split", "tf", "ctf"), M.VECTORS)
    return rows, M.fit_weights(rows.where("split = 'train'"))


def structural(df):
    rows = df.where("split <> 'test'").withColumn("is_valid", F.col("split") == "calib")
    return M.structural_pipeline(STRUCT).fit(rows)


@query
def ml_wording(spark, d):
    rows, model = wording(training(spark, d))
    out = model.transform(rows.where("split = 'test'"))
    return rounded(out.select("message_id", "label", M.positive().alias("p")), 4)


@query
def ml_structural(spark, d):
    df = training(spark, d)
    return rounded(structural(df).transform(df.where("split = 'test'").withColumn("is_valid", F.lit(False))).select("message_id", "label", M.positive().alias("p")), 4)


def blended(spark, d):
    df = training(spark, d)
    rows, model = wording(df)
    a = model.transform(rows.where("split <> 'train'")).select("message_id", "label", "split", M.logit(M.positive()).alias("wording_logit"))
    b = structural(df).transform(df.where("split <> 'train'").withColumn("is_valid", F.lit(False))).select("message_id", M.logit(M.positive()).alias("structural_logit"))
    both = cut_lineage(a.join(b, "message_id"))
    model = M.blend(both.where("split = 'calib'"))
    return both, model


@query
def ml_blend(spark, d):
    """The two coefficients and the intercept."""
    _, model = blended(spark, d)
    lr = model.stages[-1]
    w = [float(x) for x in lr.coefficients]
    return rounded(spark.createDataFrame([("structural", w[0]), ("wording", w[1]), ("intercept", float(lr.intercept))], "term string, weight double"), 4)


@query
def ml_calibrate(spark, d):
    both, model = blended(spark, d)
    scored = model.transform(both).select("message_id", "label", "split", M.logit(M.positive()).alias("raw"))
    iso = M.calibrate(scored.where("split = 'calib'"))
    return rounded(iso.transform(scored.where("split = 'test'")).select("message_id", "label", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prediction")).alias("p")), 4)


@query
def ml_vector_classifier(spark, d):
    """Classes of malicious rows from confident weak labels, fitted on the train split and told for the test split."""
    df = with_vote_result(with_votes(featured(spark, d))).where("label = 1 AND rule_vector <> 'malicious_unclassified'")
    df = cut_lineage(group_split(df, F.col("message_id")).select("message_id", "split", "rule_vector", "rule_confidence", *STRUCT))
    model = M.vector_pipeline(STRUCT).fit(df.where("rule_confidence >= 0.5 AND split = 'train'"))
    names = model.stages[0].labels
    out = model.transform(df.where("split = 'test'"))
    return out.select("message_id", "rule_vector", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("prediction") + 1).cast("int")).alias("predicted"))


@query
def ml_url_model(spark, d):
    """Link classifier split by registrable domain, so no domain is on both sides; worst link per page."""
    from lurewatch.plans.q_features import _page_links
    links = _page_links(spark, d).select("page_id", F.explode("urls").alias("u")).select("page_id", "u.raw", "u.registrable", (
        F.size(F.split("u.path", "/")) > 3).cast("int").alias("label"))
    df = cut_lineage(group_split(M.with_char_grams(links, "raw"), F.col("registrable")))
    out = M.url_pipeline().fit(df.where("split = 'train'")).transform(df.where("split = 'test'"))
    return rounded(out.groupBy("page_id").agg(F.count("*").alias("links"), F.max(M.positive()).alias("worst_p"), F.avg(M.positive()).alias("mean_p"), F.max_by("raw", M.positive()).alias("worst")), 4)


# ---- evaluation
def scores(spark, d):
    return view(spark, d, "scored")


@query
def ev_roc_auc(spark, d):
    return rounded(EV.roc_auc(scores(spark, d)))


@query
def ev_pr_auc(spark, d):
    return rounded(EV.average_precision(scores(spark, d)))


@query
def ev_brier(spark, d):
    return rounded(scores(spark, d).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.count("*").alias("n")))


@query
def ev_confusion(spark, d):
    return rounded(EV.confusion(scores(spark, d)))


@query
def ev_operating_points(spark, d):
    return rounded(EV.operating_points(scores(spark, d)))


@query
def ev_calibration_bins(spark, d):
    return rounded(EV.calibration_bins(scores(spark, d)))


@query
def ev_class_report(spark, d):
    return rounded(EV.class_report(view(spark, d, "labellers"), "b_vector", "a_vector").select("cls", F.col("support").cast("bigint").alias("support"), "precision", "recall", "f1"))


@query
def ev_bucket_accuracy(spark, d):
    df = view(spark, d, "labellers").withColumn("bucket", F.concat(F.lit("b"), (F.col("message_id") % 4).cast("string")))
    return rounded(df.groupBy("bucket").agg(F.count("*").alias("n"), F.avg((F.col("a_vector") == F.col("b_vector")).cast("double")).alias("accuracy")))


@query
def ev_leave_one_source(spark, d):
    """A token scorer fitted on all other sources by label log-odds, AUC on the source left out.

    Counts per (source, token, label) are built once; the fold without a source is the total minus that source, so no
    fold re-reads the text.
    """
    toks = messages(spark, d).select("message_id", "source", "label", F.explode(F.array_distinct(extract_all(F.lower(F.concat("subject", F.lit(" "), "body")), "[a-z]{3,}"))).alias("token"))
    per = toks.groupBy("source", "token").agg(F.sum("label").alias("b"), F.sum(1 - F.col("label")).alias("g"))
    every = per.groupBy("token").agg(F.sum("b").alias("tb"), F.sum("g").alias("tg"))
    w = per.join(every, "token").select("source", "token", F.log((F.col("tb") - F.col("b") + 1) / (F.col("tg") - F.col("g") + 1)).alias("w"))
    s = toks.join(w, ["source", "token"]).groupBy("source", "message_id", "label").agg(F.round(F.sum("w"), 6).alias("z"))
    s = s.select("source", F.col("label").alias("y"), F.round(EX.sigmoid(F.col("z")), 6).alias("p"))
    return rounded(EV.roc_auc(s, ["source"]).where("auc IS NOT NULL"))


@query
def ev_ood_recall(spark, d):
    """Recall on sources left out against the others."""
    df = scores(spark, d).withColumn("grp", F.when(hash_bucket(F.col("source")) < 25, F.lit("excluded")).otherwise(F.lit("included")))
    return rounded(df.groupBy("grp").agg(F.count_if(F.col("y") == 1).alias("n"), F.avg(F.when(F.col("y") == 1, (F.col("p") >= 0.6).cast("double"))).alias("recall")))


@query
def ev_probe(spark, d):
    """Detection and vector match per planted kind, through the whole chain."""
    from lurewatch.plans.q_scoring import scored
    df = scored(spark, d)
    return rounded(df.groupBy("kind").agg(F.count("*").alias("n"), F.avg((F.col("p_final") >= 0.5).cast("double")).alias("flagged"), F.countDistinct("vector").alias("vectors"),
                                          F.avg("severity").alias("mean_severity")), 4)


@query
def ev_language_fp(spark, d):
    df = with_language(table(spark, d, "documents").select("doc_id", "lang", "text"), "text")
    return df.groupBy("lang", "lang_detected").agg(F.count("*").alias("n"))


# ---- learner
def answers(spark, d):
    return view(spark, d, "answers").withColumn("answered_at", F.col("answered_at").cast("timestamp"))


@query
def agg_learner(spark, d):
    t = LN.by_tactic(answers(spark, d))
    return rounded(t.join(LN.levels(t).select("learner", "level", "answered"), "learner").select("learner", "tactic", "seen", "correct", "accuracy", "settled", "level", "answered"))


@query
def win_streak(spark, d):
    return LN.streaks(answers(spark, d)).select("learner", F.col("streak").cast("bigint").alias("streak"), F.col("best_streak").cast("bigint").alias("best_streak"))


@query
def win_weak_tactics(spark, d):
    t = LN.by_tactic(answers(spark, d))
    weak = LN.weak_tactics(t).select("learner", F.lit("focus").alias("kind"), F.col("rank").cast("bigint").alias("rank"), "tactic")
    return weak.unionByName(LN.strengths(t).select("learner", F.lit("strength").alias("kind"), F.col("rank").cast("bigint").alias("rank"), "tactic"))


@query
def lrn_target(spark, d):
    """Targets of each planned lesson: the answers table pairs a learner with a message."""
    lessons = answers(spark, d).select("learner", F.col("answer_id").alias("message_id"))
    feats = featured(spark, d)
    weak = LN.weak_tactics(LN.by_tactic(answers(spark, d)), 5)
    out = LN.lesson_targets(lessons, weak, feats.select("message_id", LN.available_tactics().alias("tactics")))
    return out.select("learner", "message_id", "tactic", F.col("pos").cast("bigint").alias("pos"), F.col("targets").cast("bigint").alias("targets"), F.col("required").cast("bigint").alias("required"))


@query
def lrn_grade(spark, d):
    """Every event answers the message with its id: odd answers name a class, even ones click."""
    items = pool(spark, d).select(F.col("message_id").alias("item_id"), "label", "spans")
    a = answers(spark, d).select(F.col("answer_id").alias("item_id"), (F.col("correct") == 1).alias("said_hostile"), F.when(
        F.col("answer_id") % 2 == 0, (F.col("answer_id") * 7) % 120).alias("click"))
    return LN.grade(items, a).select("item_id", "graded_right", "credited")
