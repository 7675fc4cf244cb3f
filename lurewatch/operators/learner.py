"""Learner analytics over an answers table, and which tactics a message can teach.

Fixed values: tactic keys in order, attempt and accuracy limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TACTICS = ("sender_identity", "urgency", "authority", "links", "credentials", "payment", "attachments", "pretext",
           "reply_channel", "context")
MIN_ATTEMPTS, WEAK_BELOW, STRONG_FROM = 4, 0.75, 0.85


def available_tactics() -> Column:
    """Tactics a feature row can demonstrate, in declared order; a story is always there."""
    def lex(*banks):
        out = F.lit(False)
        for b in banks:
            out = out | ((F.col(f"lex_{b}_count") + F.col(f"lexsubj_{b}")) > 0)
        return out

    when = {
        "sender_identity": F.col("brand_mismatch") | F.col("lookalike_of").isNotNull() | F.col("is_freemail") | (F.col("display_name") != ""),
        "urgency": lex("urgency", "threat"),
        "authority": lex("authority", "identity_claim", "impersonated_brand", "govt_impersonation"),
        "links": F.col("url_count") > 0,
        "credentials": lex("credential_request", "it_support"),
        "payment": lex("payment", "money_request", "crypto"),
        "attachments": (F.col("att_count") > 0) | (F.col("att_dangerous_named_in_body") > 0) | (F.col("att_any_named_in_body") > 0),
        "pretext": F.lit(True),
        "reply_channel": (F.col("tel_count") > 0) | lex("job_scam") | (F.col("tel_call_to_action") > 0),
        "context": (F.col("thr_claims_thread") > 0) | (F.col("txt_subject_is_reply") > 0),
    }
    return F.array_compact(F.array(*[F.when(when[t], F.lit(t)) for t in TACTICS]))


def by_tactic(answers: DataFrame) -> DataFrame:
    """seen, correct, accuracy and settled per learner and tactic."""
    out = answers.groupBy("learner", "tactic").agg(F.count("*").alias("seen"), F.sum("correct").cast("bigint").alias("correct"))
    return out.withColumns({"accuracy": F.col("correct") / F.col("seen"), "settled": F.col("seen") >= MIN_ATTEMPTS})


def levels(tactics: DataFrame) -> DataFrame:
    """answered, accuracy and level per learner, from the tactic rows (at most ten per learner)."""
    out = tactics.groupBy("learner").agg(F.sum("seen").alias("answered"), F.sum("correct").alias("right"))
    acc = F.col("right") / F.col("answered")
    level = (F.when((F.col("answered") < 8) | (acc < 0.70), F.lit("noticing")).when(acc < 0.88, F.lit("checking")).otherwise(F.lit("reasoning")))
    return out.withColumns({"accuracy": acc, "level": level})


def streaks(answers: DataFrame) -> DataFrame:
    """Current and best run of right answers per learner.

    Runs are folded per (learner, day) first: each day keeps its length, its leading, trailing and best run. A second
    window over the few day rows joins runs that cross midnight, so no task holds a learner's whole log in one sort.
    """
    w = Window.partitionBy("learner", "day").orderBy("answered_at", "answer_id")
    df = answers.withColumn("day", F.to_date("answered_at"))
    df = df.withColumn("miss", F.sum(1 - F.col("correct")).over(w))
    runs = df.groupBy("learner", "day", "miss").agg(F.sum("correct").alias("run"))
    days = runs.groupBy("learner", "day").agg(
        F.max("run").alias("best"), F.coalesce(F.max(F.when(F.col("miss") == 0, F.col("run"))), F.lit(0)).alias("lead"), F.max_by("run", "miss").alias("trail"), F.max("miss").alias("misses"))
    # a day without a miss extends the run of the day before; group days between days that hold a miss
    dw = Window.partitionBy("learner").orderBy("day")
    days = days.withColumn("broken", F.sum((F.col("misses") > 0).cast("int")).over(dw))
    seg = days.withColumn("piece", F.when(F.col("misses") > 0, F.col("trail")).otherwise(F.col("best")))
    # trailing run after each day = trail of the last broken day plus all unbroken days since
    seg = seg.withColumn("after", F.sum("piece").over(Window.partitionBy("learner", "broken").orderBy("day")))
    before = F.coalesce(F.lag("after").over(dw), F.lit(0))
    seg = seg.withColumn("joined", F.when(F.col("misses") > 0, F.greatest("best", before + F.col("lead"))).otherwise(F.col("after")))
    return seg.groupBy("learner").agg(F.max_by("after", "day").alias("streak"), F.max("joined").alias("best_streak"))


def weak_tactics(tactics: DataFrame, n: int = 3) -> DataFrame:
    """What to practise next: unseen tactics in declared order, then settled ones under 75% from the worst up."""
    grid = tactics.select("learner").distinct().select("learner", F.posexplode(F.array(*[F.lit(t) for t in TACTICS])).alias("ord", "tactic"))
    df = grid.join(tactics, ["learner", "tactic"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    df = df.where((F.col("seen") == 0) | (F.col("settled") & (F.col("accuracy") < WEAK_BELOW)))
    w = Window.partitionBy("learner").orderBy((F.col("seen") > 0).cast("int"), F.coalesce("accuracy", F.lit(0.0)), "ord")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("learner", "rank", "tactic", "seen", "accuracy")


def strengths(tactics: DataFrame, n: int = 3) -> DataFrame:
    df = tactics.where(F.col("settled") & (F.col("accuracy") >= STRONG_FROM))
    w = Window.partitionBy("learner").orderBy(F.desc("accuracy"), F.array_position(F.array(*[F.lit(t) for t in TACTICS]), F.col("tactic")))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("learner", "rank", "tactic", "accuracy")


def lesson_targets(lessons: DataFrame, weak: DataFrame, available: DataFrame, n_questions: int = 4) -> DataFrame:
    """For each planned lesson (learner, message_id): the learner's five weakest tactics the message can demonstrate, in
    order, and how many questions must use them. At most five rows per lesson; `available` holds an array per message."""
    pairs = lessons.join(available, "message_id").join(
        weak.select("learner", "tactic", F.col("rank").alias("weak_rank")), "learner").where(F.array_contains("tactics", F.col("tactic"))).drop("tactics")
    w = Window.partitionBy("learner", "message_id").orderBy("weak_rank")
    both = Window.partitionBy("learner", "message_id")
    out = pairs.withColumn("pos", F.row_number().over(w)).withColumn("targets", F.count("*").over(both))
    need = max(n_questions // 2, 1)
    return out.withColumn("required", F.least(F.col("targets"), F.lit(need)))


def grade(items: DataFrame, answers: DataFrame, slack: int = 12) -> DataFrame:
    """Grade label answers and clicks. `items` holds item_id, label and spans(start, end, lexicon); an answer holds
    item_id, said_hostile and click (NULL for a label question)."""
    from lurewatch.functions.common import string_map
    from lurewatch.rules.lexicons import BANK_TACTIC
    tactic = string_map(BANK_TACTIC.items())
    df = answers.join(items, "item_id")
    hit = F.get(F.filter("spans", lambda s: F.col("click").between(s.start - slack, s.end + slack)), F.lit(0))
    first = F.get(F.filter(F.transform("spans", lambda s: F.element_at(tactic, s.lexicon)), lambda t: t.isNotNull()), F.lit(0))
    df = df.withColumn("_hit", hit)
    right = F.when(F.col("click").isNotNull(), F.col("_hit").isNotNull()).otherwise((F.col("label") == 1) == F.col("said_hostile"))
    return df.withColumns({
        "graded_right": right,
        "credited": F.coalesce(F.when(F.col("_hit").isNotNull(), F.coalesce(F.element_at(tactic, F.col("_hit.lexicon")), F.lit("pretext"))),
                               first, F.lit("pretext")),
    }).drop("_hit")
