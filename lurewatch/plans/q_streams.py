"""Registered queries: streaming jobs drained over the given tables, and file sources and sinks read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lurewatch.operators import scoring as SC
from lurewatch.functions.sender import with_sender
from lurewatch.operators import style as STY
from lurewatch.plans.q_features import messages, rounded
from lurewatch.plans.q_mailbox import style_parts
from lurewatch.plans.q_scoring import intent, ioc_list, scored, vectors
from lurewatch.plans.views import VIEWS, table, view
from lurewatch.sources import corpora as C
from lurewatch.sources import mail as ML
from lurewatch.plans.scoring import score_by
from lurewatch.session import cut_lineage, ensure_checkpoint_dir
from lurewatch.sources import reports as RP
from lurewatch.streaming import jobs as J

QUERIES = {}
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
CONVS = "conv_id bigint, turn bigint, role string, text string"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def scratch(spark, name: str) -> str:
    """A fresh folder inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def mail_stream(spark, d):
    docs = J.table_source(spark, d, "documents", DOCS)
    return spark.sql(VIEWS["messages"][1], documents=docs)


@query
def st_source(spark, d):
    out = scratch(spark, "source")
    J.to_parquet(mail_stream(spark, d).select("message_id", "mailbox", "kind"), f"{out}/rows", f"{out}/cp")
    return spark.read.parquet(f"{out}/rows").groupBy("mailbox").agg(F.count("*").alias("n"))


@query
def st_dedupe(spark, d):
    """One row per text of the stream."""
    out = scratch(spark, "dedupe")
    s = mail_stream(spark, d).withColumn("key", F.md5("body")).withColumn("sent_at", F.col("sent_at").cast("timestamp"))
    J.to_parquet(J.dedupe(s, "key", within="4000 days").select("key"), f"{out}/rows", f"{out}/cp")
    return spark.read.parquet(f"{out}/rows")


@query
def st_baseline(spark, d):
    """Messages older than a date were there before; only the others pass."""
    out = scratch(spark, "baseline")
    old = messages(spark, d).where("sent_at < TIMESTAMP '2024-01-10 00:00:00'").select("message_id")
    J.to_parquet(J.without_baseline(mail_stream(spark, d).select("message_id", "kind"), old), f"{out}/rows", f"{out}/cp")
    return spark.read.parquet(f"{out}/rows")


@query
def st_score_alert(spark, d):
    out = scratch(spark, "alerts")
    known = {"prior": 0.05, "registry": view(spark, d, "domain_registry"), "iocs": ioc_list(spark)}
    J.run(mail_stream(spark, d), J.alerts(out, intent(spark, d), vectors(spark, d), **known), f"{out}/cp")
    df = spark.read.parquet(f"{out}/alerts")
    return rounded(df.select("message_id", "severity", "band", "vector", "p_final"))


@query
def st_actions(spark, d):
    out = scratch(spark, "actions")
    known = {"prior": 0.05, "registry": view(spark, d, "domain_registry"), "iocs": ioc_list(spark)}
    J.run(mail_stream(spark, d), J.actions(out, intent(spark, d), vectors(spark, d), **known), f"{out}/cp")
    df = spark.read.parquet(f"{out}/audit")
    return df.select("message_id", F.get_json_object("value", "$.would_act").alias("would_act"), F.get_json_object("value", "$.performed").alias("performed"))


def landed(spark, df, order: str, out: str, parts: int = 5):
    """Rows landed as files in `parts` slices of their time order, streamed one slice at a time."""
    cuts = df.agg(F.percentile_approx(F.unix_micros(F.col(order).cast("timestamp")), [i / parts for i in range(1, parts)])).first()[0] or []
    at = sum((F.unix_micros(F.col(order).cast("timestamp")) > c).cast("int") for c in cuts) if cuts else F.lit(0)
    df = cut_lineage(df.withColumn("_slice", at))
    for i in range(parts):
        df.where(F.col("_slice") == i).drop("_slice").coalesce(1).write.mode("append").parquet(f"{out}/in")
    return J.source(spark, f"{out}/in", df.drop("_slice").schema, max_files=1)


@query
def st_style_update(spark, d):
    """Profiles per sending domain, learned batch by batch from mail that neither model nor rules distrust."""
    out = scratch(spark, "style")
    stream = landed(spark, messages(spark, d), "sent_at", out, 2)
    known = {"prior": 0.05, "registry": view(spark, d, "domain_registry"), "iocs": ioc_list(spark)}
    model, guess = intent(spark, d), vectors(spark, d)

    def trusted(batch):
        return score_by(batch, model, guess, **known).where((F.col("p_final") < 0.5) & (F.size("binding") == 0)).select("message_id")

    def named(batch):
        return with_sender(batch).select(*batch.columns, F.col("registrable").alias("address"))

    state = J.style_state(f"{out}/profiles", fan=4)
    J.run(stream, J.style_update(out, state, trusted, named=named), f"{out}/cp")
    df = STY.from_moments(state.read(spark), "address").select(*style_parts(("n", "mean", "sd"), "address"))
    return rounded(df.select("address", "x.trait", "x.n", "x.mean", "x.sd"), 3)


def log_stream(spark, d, out):
    return landed(spark, view(spark, d, "mail_log").withColumn("ts", F.col("ts").cast("timestamp")), "ts", out)


@query
def st_history_update(spark, d):
    out = scratch(spark, "history")
    state = J.history_state(f"{out}/h", fan=4)
    J.run(log_stream(spark, d, out), J.history_update(state), f"{out}/cp")
    return state.read(spark).select("address", "received", "sent_to", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@query
def st_thread_index(spark, d):
    """Conversation turns arrive in five batches; each is verified before it joins the index."""
    out = scratch(spark, "threads")
    stream = landed(spark, view(spark, d, "threads"), "sent_at", out)
    J.run(stream, J.thread_update(out, J.thread_state(f"{out}/index", fan=4)), f"{out}/cp")
    return spark.read.parquet(f"{out}/verified").select("message_id", "q_shingles", "q_found")


def windows(spark, d, stream):
    out = scratch(spark, "windows")
    J.run(stream, lambda b, n: b.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("win"), "kind", "n").write.mode("overwrite").parquet(f"{out}/rows"), f"{out}/cp", mode="complete")
    return spark.read.parquet(f"{out}/rows")


def event_stream(spark, d):
    return J.table_source(spark, d, "events", EVENTS).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))


@query
def st_band_counts(spark, d):
    """Scored mail per hour and band, in append mode: an hour is written once the watermark has passed it, and its state goes."""
    out = scratch(spark, "bands")
    mail = scored(spark, d).select(F.col("sent_at").cast("timestamp").alias("sent_at"), "band")
    counts = J.window_counts(landed(spark, mail, "sent_at", out), "sent_at", "band", "1 hour")
    J.to_parquet(counts.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("win"), F.col("band").alias("kind"), "n"), f"{out}/rows", f"{out}/cp")
    return spark.read.schema("win string, kind string, n bigint").parquet(f"{out}/rows")


@query
def st_sliding_counts(spark, d):
    return windows(spark, d, J.window_counts(event_stream(spark, d), "ts", "kind", "1 day", "12 hours"))


@query
def st_session_counts(spark, d):
    return windows(spark, d, J.session_counts(event_stream(spark, d), "ts", "kind", "30 minutes"))


# ---- files
@query
def src_csv_corpora(spark, d):
    """Mail written as CSV with newlines inside quotes, read back and normalised."""
    out = scratch(spark, "csv")
    df = messages(spark, d).select("message_id", "sender", "receiver", "subject", "body", "label")
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(f"{out}/c")
    back = C.read_corpus_csv(spark, f"{out}/c", ["message_id", "sender", "receiver", "subject", "body", "label"])
    got = C.normalise(back, "csv")
    return got.select(F.col("message_id").cast("bigint").alias("message_id"), F.md5("body").alias("body_md5"), F.col("label").cast("bigint").alias("label"))


@query
def src_psv(spark, d):
    """Numeric columns through a pipe-separated file with some bad fields."""
    out = scratch(spark, "psv")
    df = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 2, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string")).alias("qty"))
    df.write.mode("overwrite").option("header", True).option("sep", "|").csv(f"{out}/p")
    back = C.read_psv(spark, f"{out}/p", ["l_orderkey", "qty"])
    return rounded(back.agg(F.count("*").alias("n"), F.count("qty").alias("numbers"), F.sum("qty").alias("total")), 2)


@query
def src_raw_mail(spark, d):
    """Messages composed as RFC-5322 bytes and decoded again."""
    raw = F.concat(F.lit("From: "), "sender", F.lit("\nTo: "), "receiver", F.lit("\nSubject: "), "subject", F.lit("\nDate: "),
                   F.date_format("sent_at", "d MMM yyyy HH:mm:ss"), F.lit(" +0000\nReply-To: "), "reply_to",
                   F.lit("\nMIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "body")
    df = messages(spark, d).select(F.col("message_id").cast("string").alias("path"), F.encode(raw, "UTF-8").alias("content"))
    out = ML.decode_mail(df)
    return out.select(F.col("path").cast("bigint").alias("message_id"), "sender", "subject", F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss").alias("sent"), F.md5("body").alias("body_md5"))


@query
def sink_incident_json(spark, d):
    out = scratch(spark, "incidents")
    RP.write_incidents(scored(spark, d), f"{out}/i")
    back = spark.read.text(f"{out}/i")
    return back.select(F.get_json_object("value", "$.message_id").cast("bigint").alias("message_id"), "band", F.get_json_object("value", "$.attack.vector").alias("vector"),
                       F.get_json_object("value", "$.severity.severity").cast("double").alias("severity"), F.get_json_object("value", "$.message.body").alias("body"))


@query
def sink_incident_md(spark, d):
    return RP.markdown(scored(spark, d)).select("message_id", "band", "value")


@query
def sink_audit_log(spark, d):
    out = scratch(spark, "audit")
    acted = SC.action_policy(scored(spark, d), "quarantine", 40.0)
    RP.audit_rows(acted, "quarantine").select("value").write.mode("append").text(f"{out}/a")
    back = spark.read.text(f"{out}/a").select(F.get_json_object("value", "$.would_act").alias("would_act"), F.get_json_object("value", "$.dry_run").alias("dry_run"))
    return back.groupBy("would_act", "dry_run").agg(F.count("*").alias("n"))


@query
def agg_tracked_files(spark, d):
    """First message, sender and vector per attachment digest of messages with severity 40 or more."""
    files = view(spark, d, "attachment_files").select("message_id", "digest", "filename")
    df = files.join(scored(spark, d).where("severity >= 40").select("message_id", "sent_at", "address", "vector"), "message_id")
    first = df.groupBy("digest").agg(F.count("*").alias("n"), F.min_by(F.struct("message_id", "address", "vector"), F.struct("sent_at", "message_id")).alias("f"))
    return first.select("digest", "n", "f.message_id", "f.address", "f.vector")


@query
def join_hash_reputation(spark, d):
    from lurewatch.operators.enrich import hash_reputation
    out = hash_reputation(view(spark, d, "attachment_files").select("message_id", "digest"), view(spark, d, "hash_reputation"))
    return rounded(out.select("message_id", "digest", "known", "detection_ratio"))


@query
def join_breach_prefix(spark, d):
    """Secrets quoted in mail against a leaked-hash table built from the words of the given documents."""
    from lurewatch.operators.enrich import quoted_secret_exposure
    leaked = table(spark, d, "benchmark").select(F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("w")).where(F.length("w") >= 6)
    leaked = leaked.groupBy("w").agg(F.count("*").alias("n")).select(F.left(F.upper(F.sha1("w")), F.lit(5)).alias("prefix"), F.substring(F.upper(F.sha1("w")), 6, 40).alias("suffix"), "n")
    # every message quotes one word of its own text as a secret
    word = F.get(F.filter(F.split("body", r"\s+"), lambda w: w.rlike(r"^[a-z]{6,12}$")), F.lit(0))
    df = messages(spark, d).select("message_id", F.concat(F.lit("your password is "), F.coalesce(word, F.lit("none"))).alias("note"))
    return quoted_secret_exposure(df, "note", leaked).select("message_id", "secret_quoted", "exposed", F.coalesce("exposed_count", F.lit(0)).alias("n"))


@query
def ev_evasions(spark, d):
    """Logged rewrites per technique: how many passed, and which rule still fired most. The log is the scored mail."""
    df = scored(spark, d).select(F.col("kind").alias("technique"), "p_final", F.explode_outer(F.transform("floors", lambda f: f["name"])).alias("rule"), "message_id")
    per = df.groupBy("technique", "rule").agg(F.count("*").alias("n"))
    best = per.where("rule IS NOT NULL").groupBy("technique").agg(F.min_by("rule", F.struct(-F.col("n"), "rule")).alias("still_fires"))
    tot = scored(spark, d).groupBy(F.col("kind").alias("technique")).agg(F.count("*").alias("n"), F.count_if(F.col("p_final") < 0.5).alias("passed"))
    out = tot.join(best, "technique", "left").select("technique", "n", "passed", F.coalesce("still_fires", F.lit("")).alias("still_fires"))
    return out.orderBy(F.desc("passed"), "technique").limit(8)
