"""Registered queries: campaigns, graphs and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch.functions.threads import simhash
from lurewatch.operators import campaigns as CP
from lurewatch.operators import retrieval as RT
from lurewatch.operators.sampling import group_split
from lurewatch.plans.features import prepare
from lurewatch.plans.q_features import featured, messages, rounded
from lurewatch.plans.q_scoring import scored
from lurewatch.plans.views import table, view
from lurewatch.session import cut_lineage

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def graph(spark, d, rows=None):
    """(nodes, members, edges) over feature rows; the narrow facts are written once and reused by every edge kind."""
    feats = rows if rows is not None else featured(spark, d)
    feats = cut_lineage(feats.select("message_id", "registrable", "authenticated", F.transform("urls", lambda u: F.struct(u.registrable.alias("registrable"))).alias("urls"),
                                     F.transform("phones", lambda p: F.struct(p.digits.alias("digits"))).alias("phones")))
    links = CP.link_rows(feats)
    texts = prepare(messages(spark, d)).join(feats.select("message_id"), "message_id", "left_semi") if rows is not None else prepare(messages(spark, d))
    hashes = cut_lineage(CP.text_hashes(texts))
    members = CP.memberships(feats, CP.private_links(links, CP.shared_hosts(links)), hashes)
    return feats, members, CP.star_edges(members).unionByName(CP.near_text_edges(hashes)), hashes


@query
def agg_shared_hosts(spark, d):
    return CP.shared_hosts(CP.link_rows(featured(spark, d))).select("link", "senders", "unauth")


@query
def join_common_hosts(spark, d):
    links = CP.link_rows(featured(spark, d))
    kept = CP.private_links(links, CP.shared_hosts(links)).select("link", F.lit(1).alias("kept"))
    # every link with how many of its rows survive the removal
    return links.select("link", F.lit(0).alias("kept")).unionByName(kept).groupBy("link").agg(
        F.count_if(F.col("kept") == 0).alias("n"), F.sum("kept").cast("bigint").alias("kept"))


@query
def join_near_dup(spark, d):
    """All pairs of distinct text hashes at most six bits apart."""
    docs = table(spark, d, "documents")
    docs = docs.where(F.size(F.split(F.trim("text"), r"\s+")) >= CP.MIN_WORDS)
    h = simhash(docs, "doc_id", F.col("text")).where("simhash <> 0")
    return CP.near_pairs(h).select("a", "b", F.col("distance").cast("bigint").alias("distance"))


@query
def join_near_dup_sender(spark, d):
    """Near copies inside one source, within twelve bits: a reason, not an edge."""
    docs = table(spark, d, "documents")
    long = docs.where(F.size(F.split(F.trim("text"), r"\s+")) >= CP.MIN_WORDS)
    h = simhash(long, "doc_id", F.col("text")).where("simhash <> 0").withColumnRenamed("doc_id", "message_id")
    return CP.same_sender_pairs(h, docs.select(F.col("doc_id").alias("message_id"), F.col("source").alias("sender")))


@query
def gr_links(spark, d):
    _, _, edges, _ = graph(spark, d)
    return edges.select("src", "dst", "kind", "key")


@query
def gr_components(spark, d):
    feats, members, _, hashes = graph(spark, d)
    return CP.components(feats, CP.star_edges(members).unionByName(CP.text_edges(hashes)))


def campaign_parts(spark, d):
    rows = scored(spark, d).where((F.col("p_final") >= 0.5) | (F.col("severity") >= 15))
    rows = cut_lineage(rows.select("message_id", "severity", "vector", "sent_at", "registrable", "authenticated", "urls", "phones"))
    feats, members, edges, _ = graph(spark, d, rows)
    comp = CP.components(feats, edges)
    return rows, comp, CP.campaign_facts(comp, rows, members.where("kind <> 'text'"), edges)


@query
def gr_campaigns(spark, d):
    _, comp, facts = campaign_parts(spark, d)
    return facts.select(F.concat(F.lit("campaign-"), F.col("component").cast("string")).alias("campaign"), "size", "max_score")


@query
def agg_campaign_facts(spark, d):
    _, _, facts = campaign_parts(spark, d)
    return facts.select("component", "size", "max_score", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
                        F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "sender_domains", "link_domains", "phones", "vectors", "reasons")


@query
def srt_campaigns(spark, d):
    _, _, facts = campaign_parts(spark, d)
    return facts.select("component", "size", "max_score").orderBy(F.desc("max_score"), F.desc("size"), "component")


@query
def gr_campaign_graph(spark, d):
    rows, comp, facts = campaign_parts(spark, d)
    facts = cut_lineage(facts)
    nodes, edges = CP.campaign_graph(facts, rows.join(comp, "message_id").select("component", "message_id", "severity", "vector"))
    n = nodes.groupBy("component", F.concat(F.lit("node "), "kind").alias("part")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    e = edges.groupBy("component", F.concat(F.lit("edge "), "label").alias("part")).agg(F.count("*").alias("n"), F.min(F.concat_ws(">", "source", "target")).alias("first"))
    return n.unionByName(e)


@query
def gr_lineage(spark, d):
    """Kill-chain edges per message."""
    _, edges = CP.lineage(scored(spark, d))
    return edges.select("message_id", "source", "target", "kind")


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", (F.col("label") % 2).alias("label"), F.col("label").alias("class"))


@query
def join_knn(spark, d):
    """Five nearest neighbours of every vector, cosine at least 0.45."""
    v = vectors(spark, d)
    return rounded(RT.knn(v, v, 5).select("query_id", "neighbour_id", "similarity", F.col("rank").cast("bigint").alias("rank")), 5)


@query
def top_neighbours(spark, d):
    """Class votes among the neighbours of each vector."""
    v = vectors(spark, d)
    near = RT.knn(v, v, 3).join(v.select(F.col("id").alias("neighbour_id"), F.col("class")), "neighbour_id")
    return near.groupBy("query_id", "class").agg(F.count("*").alias("n"), F.min("rank").cast("bigint").alias("best_rank"))


@query
def join_twins(spark, d):
    return rounded(RT.twins(vectors(spark, d), min_sim=0.3), 5)


@query
def ret_index_build(spark, d):
    """Train split only, unit length."""
    df = group_split(vectors(spark, d), F.col("id")).where("split = 'train'")
    df = RT.normalised(df)
    return rounded(df.select("id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("norm2"),
                             F.get("embedding", F.lit(0)).cast("double").alias("first")), 4)


@query
def ret_embed(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    df = RT.hashed_embedding(docs, "text")
    return rounded(df.select("doc_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("norm2"), F.size(
        F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("slots")), 4)
