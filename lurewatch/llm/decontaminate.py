"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is 10 consecutive words of an item (an item of fewer words is one window). A document that holds a window holds all
its words, so it is enough to join on one necessary word of each: the rarest by document-side count, ties by length then
word. Words of the documents that are no window's rarest word never leave the scan stage. A met word at place i of a
document and place q of an item fixes where the item's windows would lie (the positional bound; windows that would begin
before the text or end after it are dropped by the length bound). What is left is verified word by word against the
document, as slices of exactly the window's size.

Counting the benchmark's words, and finding the rarest ones, are a left-semi and an inner join with tables that grow with
the benchmark only; they are written first, so Catalyst broadcasts them when their measured size allows and merges
otherwise. Word counts fold on the map side; places met are gathered per document.

Words: letters A-Z lowered, runs of ASCII digits, ASCII letters and non-ASCII characters. Null texts have no words; items
without words give no window; a null item_id is read as an empty id; repeated items count once by id, repeated documents each
give their row. Empty tables: no documents give no rows, no items leave every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.common import fence
from lurewatch.llm.common import table
from lurewatch.session import cut_lineage

WIDTH = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The word class before lowering; the same runs as [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after it.
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    plain = F.coalesce(text, F.lit(""))
    low = F.when(F.length(plain) == F.octet_length(plain), F.lower(plain)).otherwise(F.translate(plain, _UPPER, _LOWER))
    return F.filter(F.split(low, _BREAK), lambda w: w != "")


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, at, words): every window of every item, at counted from 0."""
    df = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    df = df.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))).alias("at"))
    return df.select("item_id", F.slice("w", F.col("at") + 1, F.lit(width)).alias("words")).distinct()


def rarest_words(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, windows array<struct<place, words, items>>): each window under its rarest word, place counted from 0. A
    window with a word that no document holds cannot occur and is left out."""
    flat = windows.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items")).withColumn("w", F.monotonically_increasing_id())
    flat = cut_lineage(flat)
    placed = flat.select("w", "words", "items", F.posexplode("words").alias("place", "word"))
    known = placed.join(counts, "word", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    best = known.groupBy("w").agg(F.min(F.struct("count", (-F.length("word")).alias("short"), "word", "place")).alias("b"))
    rare = flat.join(best, "w").where("b.count > 0")
    return rare.groupBy(F.col("b.word").alias("word")).agg(F.collect_list(F.struct(F.col("b.place").alias("place"), "words", "items")).alias("windows"))


def _verified(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(row, w, found): each row of docs, its words, and the verified windows in it as (start, words, items)."""
    windows = cut_lineage(item_windows(items, width))
    vocabulary = cut_lineage(windows.select(F.explode("words").alias("word")).distinct())
    texts = docs.select(F.xxhash64("doc_id", "text").alias("k"), "text")
    counts = cut_lineage(texts.select(F.explode(words_of(F.col("text"))).alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("count")))
    rare = cut_lineage(rarest_words(windows, counts))
    met = texts.select("k", F.posexplode(words_of(F.col("text"))).alias("i", "word")).join(rare, "word")
    # start of the would-be window; it cannot begin before the text
    met = met.select("k", F.explode(F.transform("windows", lambda w: F.struct((F.col("i") - w.place).alias("start"), w["words"].alias("words"), w["items"].alias("items")))).alias("c"))
    met = met.where("c.start >= 0").groupBy("k").agg(F.collect_set("c").alias("c"))
    rows = docs.select(F.xxhash64("doc_id", "text").alias("k"), F.struct(*docs.columns).alias("row"))
    df = rows.join(met, "k", "left").select("row", words_of(F.col("row.text")).alias("w"), "c")
    df = fence(df, "w")  # else the words are taken apart anew for every candidate
    found = F.filter("c", lambda c: F.slice(F.col("w"), c.start + 1, F.size(c["words"])) == c["words"])
    return df.select("row", "w", F.coalesce(found, F.expr("array()")).alias("found"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) of every row of docs(doc_id, text)."""
    df = _verified(docs.select("doc_id", "text"), items, width)
    places = F.array_distinct(F.flatten(F.transform("found", lambda c: F.sequence(c.start, c.start + F.size(c["words"]) - 1))))
    ids = F.sort_array(F.array_distinct(F.flatten(F.transform("found", lambda c: c["items"]))))
    return df.select("row.doc_id", F.size("w").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                     ids.alias("items"), (F.size("found") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs that hold no window of any item, all columns as they are."""
    return _verified(docs, items, width).where(F.size("found") == 0).select("row.*")


def op6(spark, d: str) -> DataFrame:
    df = contamination(table(d, "documents", spark), table(d, "benchmark", spark))
    return df.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP6_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, array_to_string(w[p:p + 9], ' ') AS t, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, sizes WHERE len(w) >= n)),
met AS (SELECT DISTINCT r, p, n, item_id FROM dw JOIN iw USING (t, n)),
hit AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS i FROM met) GROUP BY r),
ids AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM met GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""
