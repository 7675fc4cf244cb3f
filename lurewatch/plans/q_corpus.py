"""Registered queries: sources, de-duplication, sampling, set operations and corpus aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lurewatch.functions.common import collapse, words
from lurewatch.functions.threads import content_key
from lurewatch.operators import sampling as SM
from lurewatch.operators.evaluate import exact_percentiles
from lurewatch.operators.scoring import with_vote_result, with_votes
from lurewatch.operators.skew import first_per_key, top_per_group
from lurewatch.plans.memo import planned
from lurewatch.plans.q_features import featured, messages, rounded
from lurewatch.plans.views import table, view
from lurewatch.sources import corpora as C
from lurewatch.sources.mail import header_scan, parties
from lurewatch.session import ensure_checkpoint_dir

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def corpus(spark, d):
    """Documents and labels as a two-source corpus: the label table decides where it covers a document."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("message_id"), "source", "text")
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("message_id"), "toxic", "quality")
    df = docs.join(lab, "message_id", "left")
    label = F.coalesce("toxic", (F.col("message_id") % 2).cast("int"))
    return df.select("message_id", "source", F.lit("").alias("subject"), F.col("text").alias("body"), label.cast("int").alias("label"))


@planned
def keyed(spark, d):
    df = corpus(spark, d).withColumn("content_key", content_key(F.col("subject"), F.col("body")))
    return df.withColumn("source_rank", F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"))


@query
def src_normalise(spark, d):
    """Label to 0/1, blank bodies dropped, inline subjects split off."""
    raw = messages(spark, d).select(
        "message_id", F.when(F.col("message_id") % 9 == 0, F.lit("maybe")).when(F.col("message_id") % 10 == 0, F.lit("2")).otherwise(
            F.col("label").cast("string")).alias("label"),
        F.when(F.col("message_id") % 11 == 0, F.lit("  ")).otherwise(
            F.concat(F.lit("Subject: "), "subject", F.lit("  "), "body")).alias("body"))
    out = C.normalise(raw, "flat", inline_subject=True)
    return out.select("message_id", "source", "subject", F.col("label").cast("bigint").alias("label"), F.md5("body").alias("body_md5"), "sender", "date")


@query
def src_header_only(spark, d):
    """From, To and Date out of raw header blocks; the body is never read."""
    raw = messages(spark, d).select("message_id", F.concat(
        F.lit("From: "), "sender", F.lit("\nTo: "), "receiver", F.lit("\nDate: "), F.date_format("sent_at", "d MMM yyyy HH:mm:ss"),
        F.lit(" +0000\nSubject: "), "subject", F.lit("\n\n"), "body").alias("raw"))
    return header_scan(raw, "raw", ("message_id",)).select("message_id", "from_raw", "to_raw", "date_raw")


@query
def src_optional_union(spark, d):
    """Append optional sources with other columns."""
    a = messages(spark, d).select("message_id", "source", "subject", "label")
    b = table(spark, d, "pages").select((F.col("page_id") + 1_000_000_000).alias("message_id"), F.lit("pages").alias("source"), F.col("url").alias("reply_to"))
    return C.union_sources([a, b]).select("message_id", "source", "subject", F.col("label").cast("bigint").alias("label"), "reply_to")


@query
def set_union_sources(spark, d):
    a = messages(spark, d).select("source", F.lit("message").alias("kind"))
    b = table(spark, d, "documents").select("source", F.lit("document").alias("kind"))
    return C.union_sources([a, b]).groupBy("source", "kind").agg(F.count("*").alias("n"))


@query
def src_domain_list(spark, d):
    """Hosts of pages as a newline list with comments."""
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1))
    lines = table(spark, d, "pages").select(F.concat(F.lit("  "), F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("# "), host)).otherwise(
        F.concat(F.upper(host), F.lit(" # seen")))).alias("value"))
    path = f"{ensure_checkpoint_dir(spark)}/domains-{uuid.uuid4().hex}"
    lines.write.text(path)
    return C.read_domain_list(spark, path)


@query
def src_parquet_cache(spark, d):
    """Write the keyed feature cache split by partition, read it back."""
    df = featured(spark, d).select("message_id", "kind", "url_count", "txt_body_words", "lex_payment_count")
    df = SM.group_split(df, F.col("message_id"))
    path = f"{ensure_checkpoint_dir(spark)}/cache-{uuid.uuid4().hex}"
    C.write_cache(df, path + "/features")
    back = C.read_cache(spark, path + "/features")
    return back.groupBy("split", "kind").agg(F.count("*").alias("n"), F.sum("url_count").alias("urls"), F.sum("txt_body_words").alias("words"))


@query
def sink_review_csv(spark, d):
    df = messages(spark, d).select("message_id", "source", "subject", "body")
    path = f"{ensure_checkpoint_dir(spark)}/review-{uuid.uuid4().hex}"
    rows = C.review_rows(df).select("message_id", "source", "subject", "text_preview", "true_vector")
    C.write_review(rows, path)
    out = C.read_review(spark, path, rows.columns)
    return out.select(F.col("message_id").cast("bigint").alias("message_id"), "source", "subject", F.md5("text_preview").alias("preview_md5"), "true_vector")


@query
def flt_mailbox_query(spark, d):
    from lurewatch.operators.filters import mailbox_query
    df = messages(spark, d).select("message_id", "sender", "sent_at", (F.col("message_id") % 3 == 0).alias("unread"))
    as_of = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return df.where(mailbox_query("newer_than:2m is:unread from:gmail has:star", as_of)).select("message_id")


@query
def flt_limit_latest(spark, d):
    df = messages(spark, d).select("message_id", F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss").alias("sent"))
    return df.orderBy(F.desc("sent"), F.desc("message_id")).limit(50)


@query
def agg_source_counts(spark, d):
    """Rows by class per source, with the total row from one rollup."""
    df = corpus(spark, d).rollup("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("malicious"), F.count_if(F.col("label") == 0).alias("benign"))
    return rounded(df.select(F.coalesce("source", F.lit("TOTAL")).alias("source"), "n", "malicious", "benign", (F.col("malicious") / F.col("n")).alias("share")))


@query
def agg_label_conflicts(spark, d):
    """Content keys with more than one label."""
    df = keyed(spark, d).groupBy("content_key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
    return df.where("lo <> hi").select("content_key", "n")


@query
def win_dedupe_first(spark, d):
    """Drop conflicting keys, keep the first row per key in source order."""
    df = keyed(spark, d).select("content_key", "source_rank", "message_id", "source", "label")
    agg = df.groupBy("content_key").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"),
        F.min_by(F.struct("message_id", "source", "label"), F.struct("source_rank", "message_id")).alias("r"))
    return agg.where("lo = hi").select("content_key", "r.message_id", "r.source", F.col("r.label").cast("bigint").alias("label"))


@query
def win_dedupe_per_mailbox(spark, d):
    """One row per (mailbox, message id); the same id may live in several mailboxes."""
    df = messages(spark, d).select("mailbox", (F.col("message_id") % 97).cast("string").alias("mid"), "sent_at", "message_id")
    out = first_per_key(df, ["mailbox", "mid"], [F.col("sent_at"), F.col("message_id")])
    return out.select("mailbox", "mid", "message_id")


def split(spark, d):
    return SM.group_split(keyed(spark, d), F.col("content_key"))


@query
def smp_group_split(spark, d):
    return split(spark, d).select("message_id", "split")


@query
def smp_calibration_slice(spark, d):
    return SM.calibration_slice(split(spark, d), F.col("content_key")).groupBy("split").agg(F.count("*").alias("n"))


@query
def agg_split_label(spark, d):
    out = split(spark, d).groupBy("split").pivot("label", [0, 1]).count()
    return out.select("split", F.coalesce("0", F.lit(0)).alias("benign"), F.coalesce("1", F.lit(0)).alias("malicious"))


@query
def set_split_except(spark, d):
    """Train keys are all keys minus test keys."""
    df = split(spark, d)
    return df.select("content_key").distinct().exceptAll(df.where("split = 'test'").select("content_key").distinct())


@planned
def voted(spark, d):
    return with_vote_result(with_votes(featured(spark, d)))


@query
def agg_vector_dist(spark, d):
    """Vector histogram of malicious rows with share and mean rule confidence; the total is summed over the few grouped rows."""
    df = voted(spark, d).where("label = 1").groupBy("rule_vector").agg(F.count("*").alias("n"), F.avg("rule_confidence").alias("mean_confidence"))
    total = F.sum("n").over(Window.partitionBy())  # at most one row per vector reaches this window
    return rounded(df.select("rule_vector", "n", (F.col("n") / total).alias("share"), "mean_confidence"))


@query
def smp_stratified_quota(spark, d):
    """45/35/20 quota over malicious rows: unresolved, confidence below 0.7, and 0.9 or more."""
    df = voted(spark, d).where("label = 1").select("message_id", F.when(F.col("rule_vector") == "malicious_unclassified", F.lit("unresolved")).when(
        F.col("rule_confidence") < 0.7, F.lit("low")).when(F.col("rule_confidence") >= 0.9, F.lit("high")).alias("bucket")).where("bucket IS NOT NULL")
    return SM.quota(df, ["bucket"], "message_id", "gold", {"unresolved": 45, "low": 35, "high": 20}, "bucket").select("message_id", "bucket")


@planned
def pool(spark, d):
    """Practice candidates: class and whether a tell span is present."""
    from lurewatch.functions.lexicon import with_hits
    from lurewatch.plans.features import prepare
    from lurewatch.rules.lexicons import TELL_BANKS
    df = prepare(messages(spark, d)).select("message_id", "subject", "sender", "body_text", "label", "source")
    return told(with_hits(df, only=TELL_BANKS)).withColumn("has_tell", F.size("spans") > 0)


def told(df):
    """Hits as the first twelve tell spans of the body."""
    return df.withColumn("spans", F.slice(F.filter("hits", lambda h: h.field == "body"), 1, 12)).drop("hits")


@query
def smp_practice_pool(spark, d):
    """Per class 100: of the hostile, up to 80 carry a tell and the rest do not."""
    df = pool(spark, d).select("message_id", "label", "has_tell").withColumn("cell", F.when(
        F.col("label") == 0, F.lit("benign")).when(F.col("has_tell"), F.lit("tell")).otherwise(F.lit("plain")))
    return SM.quota(df, ["cell"], "message_id", "pool", {"benign": 100, "tell": 80, "plain": 20}, "cell").select("message_id", "cell")


@query
def agg_pool_stats(spark, d):
    return pool(spark, d).groupBy("source").agg(
        F.count_if((F.col("label") == 1) & F.col("has_tell")).alias("hostile_tell"), F.count_if((F.col("label") == 1) & ~F.col("has_tell")).alias("hostile_plain"),
        F.count_if(F.col("label") == 0).alias("benign"), F.max(F.size("spans")).cast("bigint").alias("most_spans"))


@query
def smp_exercise(spark, d):
    """Question side of 20 highlight exercises: no label, no spans."""
    return exercises(messages(spark, d))


def exercises(df, n: int = 20):
    """Every hostile message is searched for a tell; only the chosen ones are searched for all of them."""
    from lurewatch.functions.lexicon import any_hit, with_hits
    from lurewatch.plans.features import prepare
    from lurewatch.rules.lexicons import TELL_BANKS
    df = prepare(df.where("label = 1")).where(any_hit(F.col("body_text"), TELL_BANKS))
    df = df.select(SM.order_hash(F.col("message_id"), "highlight").alias("h"), "message_id", "subject", "sender", "body_text").orderBy("h").limit(n)
    return told(with_hits(df, only=TELL_BANKS)).select("message_id", "subject", "sender", F.md5(collapse(F.col("body_text"))).alias("body_md5"), F.size("spans").cast("bigint").alias("n_tells"))


@query
def smp_triage_mix(spark, d):
    """A run of 24: one third hostile."""
    df = messages(spark, d).select("message_id", F.when(F.col("label") == 1, F.lit("hostile")).otherwise(F.lit("benign")).alias("cls"))
    return SM.quota(df, ["cls"], "message_id", "triage", {"hostile": 8, "benign": 16}, "cls").select("message_id", "cls")


@query
def top_hard_cases(spark, d):
    """Benign with the highest score, hostile with the lowest, and the least certain; one row per content key."""
    keys = messages(spark, d).select("message_id", content_key(F.col("subject"), F.col("body")).alias("content_key"))
    s = view(spark, d, "scored").select("message_id", "y", "p")
    n = 25
    fp = s.where("y = 0").orderBy(F.desc("p"), "message_id").limit(n)
    fn = s.where("y = 1").orderBy("p", "message_id").limit(n)
    unsure = s.orderBy(F.abs(F.col("p") - 0.5), "message_id").limit(n)
    tagged = fp.withColumn("ord", F.lit(0)).unionByName(fn.withColumn("ord", F.lit(1))).unionByName(unsure.withColumn("ord", F.lit(2)))
    picked = tagged.join(keys, "message_id").groupBy("content_key").agg(F.min(F.struct("ord", "message_id", "y", "p")).alias("o"))
    one = picked.select("o.*")
    return rounded(one.select("message_id", F.element_at(F.array(F.lit("false_positive"), F.lit("false_negative"), F.lit("uncertain")), F.col("ord") + 1).alias("why"), F.col("y").cast("bigint").alias("y"), "p"))


@query
def flt_verified_quotes(spark, d):
    """A claim counts only if its normalised 60-character quote prefix occurs in the message."""
    def norm(c):
        return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    claims = view(spark, d, "claims").select("message_id", "claim_no", F.left(norm(F.col("quote")), F.lit(60)).alias("needle"), "strength")
    msgs = messages(spark, d).select("message_id", norm(F.concat("subject", F.lit(" "), "body")).alias("hay"))
    # claims are grouped per message first, so each text is shuffled once
    per = claims.groupBy("message_id").agg(F.collect_list("needle").alias("needles"), F.max("strength").alias("strength"))
    df = msgs.join(per, "message_id")
    ok = F.size(F.filter("needles", lambda q: (q != "") & F.col("hay").contains(q)))
    df = df.select("message_id", "strength", F.size("needles").cast("bigint").alias("claims"), ok.cast("bigint").alias("verified"))
    strength = F.round(F.col("strength") * F.col("verified") / F.col("claims"), 3)
    return df.select("message_id", "claims", "verified", strength.alias("verified_strength"), ((strength >= 0.55) & (F.col("verified") >= 2)).alias("review"))


@query
def agg_percentile_grid(spark, d):
    """Twelve-point exact percentile reference of a price per flag."""
    pts = [0.01, 0.05, 0.10, 0.25, 0.40, 0.50, 0.60, 0.75, 0.90, 0.95, 0.99, 1.0]
    df = exact_percentiles(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"), lambda v: F.floor(v / 100), pts)
    return rounded(df.select("l_returnflag", F.col("pos").cast("bigint").alias("pos"), "value"), 4)


@query
def lab_consensus(spark, d):
    """Agreement of two labellers per vector; a human label outranks both."""
    df = view(spark, d, "labellers")
    agree = F.col("a_vector") == F.col("b_vector")
    df = df.withColumn("final", F.when(F.col("human_vector") != "", F.col("human_vector")).when(agree, F.col("a_vector")))
    return rounded(df.groupBy("rule_vector").agg(
        F.count("*").alias("n"), F.count_if(agree).alias("agreed"), F.count("final").alias("resolved"), F.avg(agree.cast("double")).alias("rate"),
        F.avg((F.col("final") == F.col("rule_vector")).cast("double")).alias("rule_accuracy")))
