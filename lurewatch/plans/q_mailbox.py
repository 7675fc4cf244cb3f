"""Registered queries: sender history, threads and writing style."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch.functions import style as ST
from lurewatch.functions import threads as T
from lurewatch.operators import history as H
from lurewatch.operators import style as STY
from lurewatch.operators import evaluate as EV
from lurewatch.operators.evaluate import exact_percentiles
from lurewatch.operators import threads as TH
from lurewatch.plans.memo import planned
from lurewatch.plans.q_features import messages, rounded
from lurewatch.plans.views import table, view
from lurewatch.session import cut_lineage

QUERIES = {}
STYLE_MARKS = (0.90, 0.95, 0.975, 0.99)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def log(spark, d):
    return view(spark, d, "mail_log").withColumn("ts", F.col("ts").cast("timestamp"))


def stamp(c):
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


@query
def agg_history(spark, d):
    """Per address and per domain: received, sent to, first and last seen."""
    a = H.build_history(log(spark, d), "address").select(F.lit("address").alias("kind"), F.col("address").alias("party"), "received", "sent_to", stamp("first_seen").alias("first_seen"), stamp("last_seen").alias("last_seen"))
    b = H.build_history(log(spark, d), "domain").select(F.lit("domain").alias("kind"), F.col("domain").alias("party"), "received", "sent_to", stamp("first_seen").alias("first_seen"), stamp("last_seen").alias("last_seen"))
    return a.unionByName(b)


@query
def agg_hour_histogram(spark, d):
    df = H.histograms(log(spark, d), "domain")

    def rows(kind, col):
        return df.select("domain", F.lit(kind).alias("kind"), F.explode(col).alias("slot", "n")).select("domain", "kind", F.col("slot").cast("bigint").alias("slot"), "n")
    return rows("hour", "hours").unionByName(rows("weekday", "weekdays"))


def probe_signals(spark, d):
    lg = log(spark, d)
    addr, dom = H.build_history(lg, "address"), H.build_history(lg, "domain").join(H.histograms(lg, "domain"), "domain", "left")
    # probes: every address of the log and one that never wrote, at an hour that depends on the address
    seen = lg.select("address", "domain").distinct()
    odd = seen.select(F.concat(F.lit("x"), "address").alias("address"), F.when(F.length("address") % 2 == 0, F.col("domain")).otherwise(F.lit("new.example")).alias("domain")).distinct()
    probes = seen.unionByName(odd).withColumn("hour", (F.length("address") % 24).cast("int"))
    return H.signals(probes, addr, dom, F.lit("2026-01-01 00:00:00").cast("timestamp"))


@query
def agg_history_signals(spark, d):
    return rounded(probe_signals(spark, d).select(
        "address", "domain", "sender_known", "domain_known", "first_contact", "ever_corresponded", "reply_rate",
        F.col("days_known").cast("bigint").alias("days_known"), F.col("dormant_days").cast("bigint").alias("dormant_days"), "unusual_hour"))


@query
def join_history(spark, d):
    """Address row and domain row for each event's sender; absent parties are zero."""
    lg = log(spark, d)
    a = H.build_history(lg, "address").select("address", F.col("received").alias("a_received"), F.col("sent_to").alias("a_sent"))
    b = H.build_history(lg, "domain").select("domain", F.col("received").alias("d_received"), F.col("sent_to").alias("d_sent"))
    df = lg.join(a, "address", "left").join(b, "domain", "left")
    zero = F.lit(0).cast("bigint")
    return df.select("event_id", *[F.coalesce(c, zero).alias(c) for c in ("a_received", "a_sent", "d_received", "d_sent")])


@query
def join_history_asof(spark, d):
    """History of the sending domain as of each message: strictly earlier rows only."""
    lg = log(spark, d)
    got = (F.col("direction") == "received").cast("bigint")
    df = H.history_asof(lg, ["domain"], F.col("ts"), got, F.lit(1).cast("bigint") - got)
    return df.select("event_id", "hist_received", "hist_sent", F.col("hist_first").cast("bigint").alias("hist_first"), F.col("hist_last").cast("bigint").alias("hist_last"),
                     F.col("hist_hours").cast("bigint").alias("hist_hours"))


def thread_rows(spark, d):
    return view(spark, d, "threads")


@query
def agg_thread_index(spark, d):
    """Ids, shingles and owners per mailbox."""
    df = thread_rows(spark, d)
    ids = df.groupBy("mailbox").agg(F.count("*").alias("messages"), F.countDistinct("message_id").alias("ids"))
    sh = TH.shingle_index(df).groupBy("mailbox").agg(F.count("*").alias("shingles"), F.countDistinct("owner").alias("owners"))
    return ids.join(sh, "mailbox")


@query
def join_thread_ids(spark, d):
    """In-Reply-To resolves to an indexed id."""
    df = messages(spark, d)
    return TH.resolve_ids(df.select("message_id", T.message_ids(F.col("in_reply_to")).alias("refs")), df.select(
        F.concat(F.col("message_id").cast("string"), F.lit("@box")).alias("id")))


@query
def join_thread_shingles(spark, d):
    """Share of quoted shingles already in the mailbox, earlier messages only."""
    df = thread_rows(spark, d)
    m = TH.quote_match(df, TH.shingle_index(df))
    return rounded(m.select("message_id", "q_shingles", "q_found", (F.col("q_found") / F.col("q_shingles")).alias("ratio")))


@query
def win_growing_index(spark, d):
    return TH.index_size(thread_rows(spark, d))


@query
def sc_thread_verdict(spark, d):
    v = TH.verify(thread_rows(spark, d))
    return rounded(v.select("message_id", "claims_thread", "indexed", F.col("q_tokens").cast("bigint").alias("q_tokens"), "quote_match", "matched", "fabricated", "indeterminate"))


@query
def ev_thread_replay(spark, d):
    """Replay of the growing index per mailbox."""
    v = TH.verify(thread_rows(spark, d))
    return rounded(v.groupBy("mailbox").agg(
        F.count_if("claims_thread").alias("claims"), F.count_if("matched").alias("matched"), F.count_if("indeterminate").alias("indeterminate"),
        F.count_if("fabricated").alias("fabricated"), (F.count_if("fabricated") / F.greatest(F.count_if("claims_thread"), F.lit(1))).alias("rate")))


@planned
def style_rows(spark, d):
    """Trait arrays of all documents, written once: profile, population and comparisons read them."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("address"), "text")
    return cut_lineage(STY.trait_rows(docs, "text", "doc_id", "address"))


def style_parts(arrays, *keep):
    """Arrays by trait as rows."""
    parts = F.arrays_zip(F.array(*[F.lit(t) for t in ST.TRAIT_NAMES]).alias("trait"), *[F.col(a) for a in arrays])
    return [*keep, F.explode(parts).alias("x")]


@query
def agg_style_profile(spark, d):
    df = STY.profile(style_rows(spark, d)).select(*style_parts(("n", "mean", "sd"), "address"))
    return rounded(df.select("address", "x.trait", "x.n", "x.mean", "x.sd"), 4)


@query
def agg_style_population(spark, d):
    df = STY.population(STY.profile(style_rows(spark, d))).select(*style_parts(("senders", "pop_mean", "pop_sd")))
    return rounded(df.select("x.trait", "x.senders", "x.pop_mean", "x.pop_sd").where("senders >= 3"), 4)


def style_dev(spark, d):
    rows = style_rows(spark, d)
    prof = STY.profile(rows)
    return STY.deviations(rows, prof, STY.population(prof), learned=True)


@query
def join_style(spark, d):
    """Message traits against the sender's profile and the population spread."""
    df = style_dev(spark, d).select("doc_id", F.explode("dev").alias("x"))
    return rounded(df.select("doc_id", "x.trait", "x.own_n", "x.zm", "x.zc"), 3)


@query
def sc_style_drift(spark, d):
    return rounded(STY.drift(style_dev(spark, d), "doc_id"), 4)


@query
def win_top_traits(spark, d):
    return rounded(STY.top_traits(style_dev(spark, d), "doc_id"), 3)


@planned
def trial(spark, d):
    return cut_lineage(STY.impostor_trial(style_rows(spark, d), "doc_id"))


@query
def ev_style_auc(spark, d):
    """Does a profile know its author? Per-sender AUC of drift between own and other writers' messages, and what a threshold at a
    percentile of genuine drift accuses and catches."""
    df = cut_lineage(STY.drift(trial(spark, d), "target", "genuine", "doc_id").select("target", "genuine", F.round("drift", 6).alias("drift")))
    auc = cut_lineage(EV.roc_auc(df.select(F.col("target").alias("sender"), (~F.col("genuine")).cast("int").alias("y"), F.col("drift").alias("p")), ["sender"]).where("auc IS NOT NULL"))
    measured = df.join(auc.select(F.col("sender").alias("target")), "target", "left_semi")
    one = auc.agg(F.count("*").cast("double").alias("senders"), F.avg("auc").alias("auc mean"), F.avg((F.col("auc") > 0.5).cast("double")).alias("auc above half"))
    sizes = measured.agg(F.count_if("genuine").cast("double").alias("own messages"), F.count_if(~F.col("genuine")).cast("double").alias("other messages"))

    def tall(frame):
        return frame.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.lit(None).cast("double").alias("pct"), F.col(f"`{c}`").alias("value")) for c in frame.columns])).alias("x")).select("x.*")
    median = exact_percentiles(auc.withColumn("all", F.lit(1)), ["all"], F.col("auc"), lambda v: F.floor(v * 1000), [0.5])
    median = median.select(F.lit("auc median").alias("measure"), F.lit(None).cast("double").alias("pct"), "value")
    marks = exact_percentiles(measured.where("genuine").withColumn("all", F.lit(1)), ["all"], F.col("drift"), lambda v: F.floor(v * 1000), list(STYLE_MARKS))
    marks = marks.select(F.element_at(F.array(*[F.lit(100 * m) for m in STYLE_MARKS]), F.col("pos") + 1).alias("pct"), F.round("value", 6).alias("value"))
    marks = marks.unionByName(spark.createDataFrame([(0.0, float(ST.SUSPICIOUS))], "pct double, value double"))  # the shipped threshold
    told = measured.crossJoin(F.broadcast(marks)).groupBy("pct").agg(  # five rows
        F.avg(F.when(F.col("genuine"), (F.col("drift") > F.col("value")).cast("double"))).alias("accused"),
        F.avg(F.when(~F.col("genuine"), (F.col("drift") > F.col("value")).cast("double"))).alias("caught"))
    told = told.select("pct", F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in ("accused", "caught")])).alias("x")).select("x.measure", "pct", "x.value")
    out = tall(one).unionByName(tall(sizes)).unionByName(median).unionByName(marks.select(F.lit("threshold").alias("measure"), "pct", "value")).unionByName(told)
    return rounded(out, 4)


@query
def ev_style_trait_rank(spark, d):
    """The traits that most often tell two writers apart: how far the six that moved most moved, over all impostor pairs."""
    top = STY.top_traits(trial(spark, d).where("NOT genuine"), "doc_id")
    return rounded(top.groupBy("trait").agg(F.sum("moved").alias("separation")).orderBy(F.desc(F.round("separation", 6)), "trait").limit(10), 3)
