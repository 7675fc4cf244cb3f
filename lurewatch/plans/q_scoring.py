"""Registered queries: scoring (2.7), verdict projections and filters (2.2), triage and coverage aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lurewatch.functions.body import evidence_files
from lurewatch.operators import history as H
from lurewatch.operators import recipient as R
from lurewatch.operators import scoring as SC
from lurewatch.plans.memo import planned
from lurewatch.plans.q_features import featured, featured_text, messages, rounded
from lurewatch.operators import intent as IN
from lurewatch.plans.scoring import ioc_hits, marked, score_rows, with_state
from lurewatch.plans.views import table, view
from lurewatch.rules import dims
from lurewatch.rules import taxonomy as X
from lurewatch.session import cut_lineage, ensure_checkpoint_dir

QUERIES = {}
IOCS = ("paypa1.com", "mailer.top", "parcel-fee.xyz")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def ioc_list(spark):
    return spark.createDataFrame([(d,) for d in IOCS], "domain string")


@planned
def rows(spark, d):
    """Feature rows of all messages, written once: the models are fitted on them and the score reads them."""
    return marked(featured_text(spark, d))


@planned
def intent(spark, d):
    """The intent model, fitted, saved as a version in the shared folder and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/intent-{uuid.uuid4().hex}"
    IN.fit_intent(rows(spark, d)).save(path, 1)
    return IN.IntentModel.load(spark, path)


@planned
def vectors(spark, d):
    """Weights and totals of the vector classifier."""
    return IN.fit_vectors(SC.with_vote_result(SC.with_votes(rows(spark, d))))


@planned
def predicted(spark, d):
    """Feature rows with p_model, clf_vector and clf_p, each from models that did not see the row's content."""
    df = rows(spark, d)
    p = intent(spark, d).predict(df).withColumnRenamed("p", "p_model")
    guess = IN.predict_vectors(df, *vectors(spark, d))
    return df.drop("words", "shape").join(cut_lineage(p.join(guess, "message_id")), "message_id")


@planned
def state(spark, d):
    """Feature rows with mailbox history and domain age."""
    return with_state(featured(spark, d), view(spark, d, "domain_registry"), True)


@planned
def floored(spark, d):
    df = with_state(predicted(spark, d), view(spark, d, "domain_registry"), True).withColumn("p_prior", F.col("p_model"))
    return SC.apply_floors(SC.with_floors(df), "p_prior")


@planned
def voted(spark, d):
    return SC.with_vote_result(SC.with_votes(featured(spark, d)))


def _scored(spark, d, prior=None):
    return score_rows(predicted(spark, d), prior, view(spark, d, "domain_registry"), True, ioc_list(spark), R.profiles(messages(spark, d)), ("clf_vector", "clf_p"))


@planned
def scored(spark, d):
    return _scored(spark, d)


@query
def sc_prior_adjust(spark, d):
    df = view(spark, d, "scored").select("message_id", "p")
    return rounded(df.select("message_id", "p", *[SC.prior_adjust(F.col("p"), q).alias(n) for n, q in (
        ("at_5pct", 0.05), ("at_2pct", 0.02), ("off", None), ("certain", 1.0))]))


@query
def sc_floors(spark, d):
    return SC.with_floors(state(spark, d)).select("message_id", F.explode("floors").alias("f")).select(
        "message_id", F.col("f.name").alias("floor"), "f.minimum")


@query
def sc_floor_apply(spark, d):
    return rounded(floored(spark, d).select("message_id", "p_prior", "p_final", F.size("floors").cast("bigint").alias("fired"),
                                            F.size("binding").cast("bigint").alias("binding")))


@query
def sc_floor_vector(spark, d):
    df = floored(spark, d).select("message_id", SC.floor_vector(F.col("binding")).alias("v"))
    return df.where("v IS NOT NULL").select("message_id", "v.vector", F.col("v.name").alias("floor"))


@query
def join_floor_vector(spark, d):
    """The floor table as a broadcast dimension: implied vector per exploded binding floor, best first."""
    from lurewatch.rules.floors import FLOORS
    dim = spark.createDataFrame([(f.name, f.vector, i) for i, f in enumerate(FLOORS)], "name string, vector string, ord int")
    ex = floored(spark, d).select("message_id", F.explode("binding").alias("f")).select("message_id", "f.name", "f.minimum")
    df = ex.join(F.broadcast(dim), "name").where("vector IS NOT NULL")
    return df.groupBy("message_id").agg(F.min_by(F.col("vector"), F.struct(-F.col("minimum"), "ord")).alias("vector"),
                                        F.max("minimum").alias("minimum"), F.count("*").alias("mapped"))


@query
def sc_votes(spark, d):
    return SC.with_votes(featured(spark, d)).select("message_id", F.explode("votes").alias("v")).select(
        "message_id", "v.lf", "v.vector", "v.weight")


@query
def sc_vote_resolve(spark, d):
    return voted(spark, d).select("message_id", "rule_vector", "rule_confidence", "rule_weight")


@query
def win_vote_margin(spark, d):
    """Winner, runner-up, share and margin."""
    df = voted(spark, d)
    top, second, total = F.col("rule_weight"), F.col("runner_up_weight"), F.col("total_weight")
    return rounded(df.where("total_weight > 0").select(
        "message_id", F.col("rule_weight").alias("winner_weight"), "runner_up_weight", (top / total).alias("share"), ((top - second) / top).alias("margin")))


@query
def sc_vector_resolve(spark, d):
    df = SC.with_vote_result(SC.with_votes(floored(spark, d)))
    return rounded(SC.resolve_vector(df, "p_final", "clf_vector", "clf_p").select(
        "message_id", "vector", "vector_confidence", "vector_source"))


@query
def sc_exploitability(spark, d):
    df = featured(spark, d)
    return rounded(df.select("message_id", SC.exploitability().alias("exploitability")))


@query
def sc_targeting(spark, d):
    return rounded(featured(spark, d).select("message_id", SC.targeting().alias("targeting")))


@query
def agg_recipient_profile(spark, d):
    return rounded(R.profiles(messages(spark, d)))


@query
def sc_recipient_mult(spark, d):
    df = voted(spark, d).select("message_id", "mailbox", "rule_vector")
    return rounded(R.with_multiplier(df, R.profiles(messages(spark, d)), vector="rule_vector").select("message_id", "rule_vector", "r_mult"))


@query
def join_recipient(spark, d):
    df = voted(spark, d).select("message_id", "mailbox", "rule_vector")
    df = R.with_multiplier(df, R.profiles(messages(spark, d)), vector="rule_vector")
    return rounded(df.where("r_area IS NOT NULL").groupBy("mailbox", "r_area").agg(
        F.count("*").alias("n"), F.avg("r_mult").alias("mean_mult"), F.max("r_messages").alias("messages")))


@query
def sc_severity(spark, d):
    return rounded(scored(spark, d).select("message_id", "vector", "impact", "exploitability", "targeting", "escalation", "base_score",
                                           "severity", "band"))


@query
def sc_arithmetic(spark, d):
    return scored(spark, d).select("message_id", SC.arithmetic().alias("arithmetic"))


@query
def sc_pipeline(spark, d):
    """The whole chain with a 5% deployment prior."""
    df = _scored(spark, d, 0.05)
    return rounded(df.select("message_id", "p_model", "p_prior", "p_final", "verdict", "decided_by", "vector", "vector_source",
                             "severity", "band", F.size("binding").cast("bigint").alias("binding")))


@query
def prj_verdict(spark, d):
    return rounded(floored(spark, d).select("message_id", "p_final", SC.verdict(F.col("p_final")).alias("verdict"), F.when(
        F.size("binding") > 0, F.lit("deterministic rule")).otherwise(F.lit("model")).alias("decided_by")))


@query
def flt_band_floor(spark, d):
    df = scored(spark, d).where(SC.band_rank(F.col("band")) >= X.BAND_RANK["MEDIUM"])
    return df.select("message_id", "band", "severity")


@query
def flt_action_policy(spark, d):
    return SC.action_policy(scored(spark, d), "quarantine", 40.0).select("message_id", "act", "reason")


@query
def prj_iocs(spark, d):
    """Indicators per message: (kind, value)."""
    df = featured(spark, d)

    def kind(name, values):
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("kind"), v.alias("value")))
    doms = F.array_sort(F.array_distinct(F.filter(F.transform("urls", lambda u: u.registrable), lambda x: x != "")))
    all_ = F.concat(
        kind("sender_address", F.filter(F.array("address"), lambda a: a != "")),
        kind("sender_domain", F.filter(F.array("registrable"), lambda a: a != "")),
        kind("url", F.transform("urls", lambda u: u.raw)), kind("url_domain", doms), kind("attachment", F.col("attachment_names")),
        kind("dangerous_file", evidence_files()))
    return df.select("message_id", F.explode(all_).alias("i")).select("message_id", "i.kind", "i.value")


@query
def prj_card(spark, d):
    """Triage card projection."""
    df = scored(spark, d)
    return rounded(df.select("message_id", "subject", "address", "registrable", "verdict", "vector", "severity", "band",
                             F.size("urls").cast("bigint").alias("links"), F.size("attachment_names").cast("bigint").alias("files"),
                             F.coalesce(F.get("binding", F.lit(0)).getField("name"), F.lit("")).alias("top_rule")))


@query
def prj_detail(spark, d):
    """Full detail: evidence flattened to text columns."""
    df = scored(spark, d)
    return rounded(df.select(
        "message_id", "address", "display_name", "claimed_brand", "lookalike_of", "authenticated", "p_model", "p_prior", "p_final",
        "vector", "rule_vector", "rule_confidence", "severity", "band",
        F.array_join(F.transform("urls", lambda u: u.raw), " ").alias("links"),
        F.array_join(F.transform("phones", lambda p: p.digits), " ").alias("numbers"),
        F.array_join(F.transform("binding", lambda f: f["name"]), ",").alias("rules"),
        F.array_join(F.transform("votes", lambda v: v.lf), ",").alias("votes")))


@query
def prj_response_plan(spark, d):
    """Vector to playbook steps and band to posture."""
    steps = spark.createDataFrame(list(X.PLAYBOOK.items()), "vector string, steps string")
    posture = spark.createDataFrame(list(X.POSTURE.items()), "band string, posture string")
    df = scored(spark, d).select("message_id", "vector", "band")
    df = df.join(F.broadcast(steps), "vector").join(F.broadcast(posture), "band")
    return df.select("message_id", "vector", "band", "posture", F.posexplode(F.split("steps", r"\|")).alias("pos", "step")).select(
        "message_id", "vector", "band", "posture", F.col("pos").cast("bigint").alias("pos"), "step")


@query
def join_taxonomy(spark, d):
    dim = spark.createDataFrame([(k, n, i, ",".join(m)) for k, n, i, m in X.VECTORS], "vector string, name string, impact double, mitre string")
    kinds = voted(spark, d).select("message_id", F.when(F.col("message_id") % 7 == 0, F.lit("unheard_of")).otherwise(F.col("rule_vector")).alias("vector"))
    return kinds.join(F.broadcast(dim), "vector", "left").select(
        "message_id", "vector", F.coalesce("impact", F.lit(X.DEFAULT_IMPACT)).alias("impact"), "name", "mitre")


@query
def srt_triage(spark, d):
    """Which messages need attention and why: severity first, top 40."""
    df = scored(spark, d).select("message_id", "subject", "address", "vector", "severity", "band", F.coalesce(
        F.get("binding", F.lit(0)).getField("name"), F.lit("")).alias("rule"))
    return df.orderBy(F.desc("severity"), "message_id").limit(40)


@query
def agg_triage_counts(spark, d):
    """Messages per band, every band present, plus how many were flagged."""
    got = scored(spark, d).groupBy("band").agg(F.count("*").alias("n"), F.count_if(F.col("p_final") >= 0.5).alias("flagged"))
    bands = spark.createDataFrame([(b,) for _, b in X.BANDS], "band string")
    return bands.join(got, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("flagged", F.lit(0)).alias("flagged"))


@query
def agg_band_by_vector(spark, d):
    bands = [b for _, b in X.BANDS]
    out = scored(spark, d).groupBy("vector").pivot("band", bands).count()
    return out.select("vector", *[F.coalesce(b, F.lit(0)).alias(b.lower()) for b in bands])


@query
def agg_coverage(spark, d):
    """Resolution mix, share with a plan, indicators per message, precision of the upper bands."""
    df = scored(spark, d).withColumn("n_iocs", F.size("urls") + F.size("attachment_names") + F.lit(2))
    flagged = F.col("p_final") >= 0.5
    high = flagged & F.col("band").isin("HIGH", "CRITICAL", "MEDIUM")
    return rounded(df.agg(
        F.count("*").alias("n"), F.count_if(flagged).alias("flagged"),
        F.count_if(flagged & (F.col("vector_source") == "rule") & (F.col("vector") != "malicious_unclassified")).alias("by_rule"),
        F.count_if(flagged & (F.col("vector") == "malicious_unclassified")).alias("unresolved"),
        F.avg(F.when(flagged, (F.col("vector") != "malicious_unclassified").cast("double"))).alias("plan_share"),
        F.avg((F.col("n_iocs") > 2).cast("double")).alias("ioc_share"), F.avg(F.when(flagged, F.col("n_iocs"))).alias("ioc_mean"),
        F.avg(F.when(high, (F.col("label") == 1).cast("double"))).alias("band_precision")))


@query
def ev_floor_audit(spark, d):
    """Per floor: fired, fired on benign, and what it changed on either side of 0.5."""
    df = floored(spark, d).select("message_id", "label", "p_prior", "p_final", F.explode("floors").alias("f"))
    lifted = (F.col("p_prior") < 0.5) & (F.col("f.minimum") > F.col("p_prior"))
    out = df.groupBy(F.col("f.name").alias("floor")).agg(
        F.count("*").alias("fired"), F.count_if(F.col("label") == 0).alias("fired_benign"),
        F.count_if(lifted & (F.col("label") == 1)).alias("new_tp"), F.count_if(lifted & (F.col("label") == 0)).alias("new_fp"))
    return rounded(out.withColumn("benign_rate", F.col("fired_benign") / F.col("fired")))


@query
def join_ioc(spark, d):
    df = ioc_hits(featured(spark, d), ioc_list(spark))
    return df.where("ioc_hit").select("message_id")


@query
def set_ioc_intersect(spark, d):
    """Observed domains that are on the known-bad list."""
    df = featured(spark, d)
    seen = df.select(F.explode(F.concat(F.array("registrable"), F.transform("urls", lambda u: u.registrable))).alias("domain"))
    return seen.select("domain").intersect(ioc_list(spark))


@query
def join_allowlist(spark, d):
    """Executable-link evidence without allowlisted senders or link domains."""
    allow = spark.createDataFrame([("203.0.113.9",), ("partner.example.net",), ("example.net",)], "domain string")
    df = featured(spark, d).select("message_id", "registrable", F.explode("urls").alias("u"))
    df = df.select("message_id", "registrable", F.col("u.raw").alias("raw"), F.col("u.registrable").alias("link"), F.col("u.ext").alias("ext"))
    df = df.where(F.col("ext").isin(*dims.HARD_EXECUTABLE_EXT))
    df = df.join(allow.select(F.col("domain").alias("registrable")), "registrable", "left_anti")
    return df.join(allow.select(F.col("domain").alias("link")), "link", "left_anti").select("message_id", "registrable", "link", "raw")


@query
def join_domain_age(spark, d):
    from lurewatch.operators.enrich import domain_age
    df = featured(spark, d).select("message_id", "registrable", "sent_at")
    return domain_age(df, view(spark, d, "domain_registry"), F.to_date("sent_at")).select(
        "message_id", "registrable", F.col("domain_age_days").cast("bigint").alias("domain_age_days"))


@query
def join_dims(spark, d):
    """Membership of sender domains in the reference sets, as a join to one dimension table."""
    from lurewatch.functions.sender import with_sender
    rows = ([(v, "freemail") for v in dims.FREEMAIL] + [(v, "brand") for v in dims.LEGIT_DOMAINS] + [(v, "shortener") for v in dims.SHORTENERS])
    dim = spark.createDataFrame(rows, "registrable string, kind string")
    tld = spark.createDataFrame([(v, "high_risk_tld") for v in dims.HIGH_RISK_TLDS], "tld string, kind string")
    df = with_sender(messages(spark, d).select("message_id", "sender")).select("message_id", "registrable", "tld")
    hits = df.join(F.broadcast(dim), "registrable").select("message_id", "registrable", "kind").unionByName(
        df.join(F.broadcast(tld), "tld").select("message_id", "registrable", "kind"))
    return hits.groupBy("registrable", "kind").agg(F.count("*").alias("n"))


@query
def join_lookalike(spark, d):
    """Near misses of well-known domains: length-bucketed equi join over distinct domains, then edit distance."""
    from lurewatch.operators.lookalike import near_domains
    from lurewatch.functions.sender import with_sender
    df = with_sender(messages(spark, d).select("message_id", "sender")).select("registrable")
    return near_domains(df).select("registrable", "lookalike_of", F.col("distance").cast("bigint").alias("distance"))


@query
def flt_auth_ham(spark, d):
    """Authenticated mail kept as benign training rows, with what was skipped, per domain."""
    df = featured(spark, d)
    return df.groupBy("registrable").agg(F.count_if("authenticated").alias("kept"), F.count_if(~F.col("authenticated")).alias("skipped"))


@query
def agg_top_domains(spark, d):
    df = featured(spark, d).where("authenticated")
    return df.groupBy("registrable").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "registrable").limit(8)


@query
def tac_available(spark, d):
    """Which tactic families each message can demonstrate."""
    from lurewatch.operators.learner import available_tactics
    df = featured(spark, d)
    return df.select("message_id", F.explode(available_tactics()).alias("tactic"))
