"""Ranked lexical search by presence masks.

The queries (items) are taken in blocks of about BLOCK item terms, so that what every worker holds of them is bounded; each block
meets all documents. A first pass over the whole texts writes, per document, its length and how often each term of the block
occurs. Totals (documents, words, document frequencies) are counted over that table. A second pass scores.

In the second pass a worker inverts a batch of documents by term and gives each (document, term) its share of the score. For an
item, every document gets a bitmap with a bit per term it holds; documents with equal bitmaps are one group. What
a group can reach at most is the sum of its terms' largest shares. Groups are evaluated from the highest such bound down, and
the search of the batch ends when the next bound lies below the k-th best score so far, which the task carries from batch to
batch. Equal bounds are still evaluated, as a smaller doc_id may win the tie. Each task hands on k rows an item at most.

A term's share is integer arithmetic (see `share`), so sums do not depend on their order.

Null and wordless texts are no documents, and items without terms find nothing. Every row of both tables counts for itself: repeated rows
are found side by side with equal scores, a repeated item gives its list again. A null doc_id comes before
others of equal score. Empty tables give no rows; other columns are not read. Texts are whole; one may be of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm.common import Words, batches, flat, ship, table
from lurewatch.session import cut_lineage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP, BLOCK = 20, 1 << 16
SLICES = 32  # an item's candidates are cut down in this many slices first

_LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_IS_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({TERM})"), 1)


class Terms:
    """The terms of a block, found in slices of texts by fingerprint and then compared byte by byte."""

    def __init__(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.first = np.cumsum(self.size) - self.size
        places = Words(self.bytes, np.append(self.first, len(self.bytes)))
        for self.which in (0, 1):
            names = places.names(self.which)
            self.order = np.argsort(names)
            self.names = names[self.order]
            if (self.names[1:] != self.names[:-1]).all():
                return
        raise ValueError("two terms share both fingerprints")

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms in all, document, term, times): per text its length, and the counts of the block's terms, by document."""
        buf, offsets = flat(texts)
        buf = _LOWERED[buf]
        words = Words(buf, offsets, _IS_TERM)
        length = np.diff(words.first)
        if not len(self.names) or not len(words.start):
            none = np.zeros(0, np.int64)
            return length, none, none, none
        names = words.names(self.which)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        hit = np.flatnonzero(self.names[at] == names)
        term = self.order[at[hit]]
        begin, size = words.start[hit], words.end[hit] - words.start[hit]
        same = size == self.size[term]
        term, begin, size, hit = term[same], begin[same], size[same], hit[same]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        wrong = buf[np.repeat(begin, size) + step] != self.bytes[np.repeat(self.first[term], size) + step]
        if wrong.any():
            right = ~np.logical_or.reduceat(wrong, np.cumsum(size) - size)
            term, hit = term[right], hit[right]
        doc = np.searchsorted(words.first, hit, "right") - 1
        pair, times = np.unique(doc * len(self.size) + term, return_counts=True)
        return length, pair // len(self.size), pair % len(self.size), times


def _lists(values: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))


def term_counts(docs: DataFrame, words) -> DataFrame:
    """(doc_id, n, terms, times) of every document with a term; `words` is a broadcast list."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "terms" not in state:
            state["terms"] = Terms(words.value)
        length, doc, term, times = state["terms"].find(batch.column(1))
        out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(length, pa.int64()), _lists(term, doc, len(length)), _lists(times, doc, len(length))], ["doc_id", "n", "terms", "times"])
        return out.filter(pa.array(length > 0))

    state: dict = {}
    return batches(docs.select("doc_id", "text"), work, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, terms array<int>, times array<int>")


def share(weight: np.ndarray, times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * times) // (1000 * times + 12 * m))


class Batch:
    """Documents of a batch, inverted by term."""

    def __init__(self, batch: pa.RecordBatch, weight: np.ndarray, n_docs: int, n_words: int) -> None:
        self.ids, n = batch.column(0), np.asarray(batch.column(1), np.int64)
        m = 75 + (25 * n * n_docs) // n_words
        lists, times = batch.column(2), np.asarray(batch.column(3).flatten(), np.int64)
        doc = np.repeat(np.arange(len(n)), np.diff(np.asarray(lists.offsets)))
        term = np.asarray(lists.flatten(), np.int64)
        by = np.argsort(term, kind="stable")
        self.doc, self.share = doc[by], share(weight[term], times, m[doc])[by]
        self.first = np.searchsorted(term[by], np.arange(len(weight) + 1))
        self.peak = np.zeros(len(weight), np.int64)
        held = np.flatnonzero(np.diff(self.first))
        if len(held):
            self.peak[held] = np.maximum.reduceat(self.share, self.first[held])

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits of each distinct mask, its documents one mask after another, where each mask's documents begin)."""
        words = np.zeros(((len(terms) + 63) // 64, len(self.ids)), np.uint64)
        for j, t in enumerate(terms):
            words[j >> 6, self.doc[self.first[t]: self.first[t + 1]]] |= np.uint64(1 << (j & 63))
        some = np.flatnonzero(words.any(axis=0))
        words = words[:, some]
        by = np.lexsort(words)
        words, some = words[:, by], some[by]
        new = np.flatnonzero(np.concatenate(([True], (words[:, 1:] != words[:, :-1]).any(axis=0)))) if len(some) else np.zeros(0, np.int64)
        bits = np.unpackbits(np.ascontiguousarray(words[:, new].T).view(np.uint8), axis=1, bitorder="little")[:, : len(terms)].astype(bool)
        return bits, some, np.append(new, len(some))

    def scores(self, docs: np.ndarray, held: np.ndarray, terms: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """Exact scores of documents whose held terms are known (a row of `held` each)."""
        out = np.zeros(len(docs), np.int64)
        for j, t in enumerate(terms):
            on = held[:, j]
            a, b = self.first[t], self.first[t + 1]
            out[on] += repeats[j] * self.share[a + np.searchsorted(self.doc[a:b], docs[on])]
        return out


def _order(row: tuple) -> tuple:
    return -row[0], row[1] is not None, row[1]


def best_of(batch: Batch, terms: np.ndarray, repeats: np.ndarray, best: list[tuple], top: int) -> list[tuple]:
    """The `top` best (score, doc_id) of an item over `best` and a batch."""
    useful = batch.peak[terms] > 0
    terms, repeats = terms[useful], repeats[useful]
    if not len(terms):
        return best
    bits, docs, begin = batch.masks(terms)
    bound = bits @ (repeats * batch.peak[terms])
    group, next_size, a = np.argsort(-bound, kind="stable"), 2 * top, 0
    count = np.cumsum((begin[1:] - begin[:-1])[group])
    while a < len(group) and (len(best) < top or bound[group[a]] >= best[-1][0]):
        b = max(a + 1, int(np.searchsorted(count, (count[a - 1] if a else 0) + next_size, "right")))
        if len(best) == top:
            b = a + max(1, int(np.searchsorted(-bound[group[a:b]], -best[-1][0], "right")))
        size = (begin[1:] - begin[:-1])[group[a:b]]
        place = np.arange(size.sum()) + np.repeat(begin[group[a:b]] - np.cumsum(size) + size, size)
        found = docs[place]
        scores = batch.scores(found, bits[np.repeat(group[a:b], size)], terms, repeats)
        least = best[-1][0] if len(best) == top else 1
        good = np.flatnonzero(scores >= least)
        if len(good) > top:  # ties with the last of them stay in, to be told apart by doc_id
            good = good[scores[good] >= np.partition(scores[good], len(good) - top)[len(good) - top]]
        best = sorted(best + list(zip(scores[good].tolist(), batch.ids.take(pa.array(found[good])).to_pylist())), key=_order)[:top]
        a, next_size = b, 2 * next_size
    return best


def _candidates(block, top: int):
    def run(it):
        b = block.value
        best: dict[int, list] = {i: [] for i in range(len(b["items"]))}
        kind = None
        for batch in it:
            kind = batch.column(0).type
            inverted = Batch(batch, b["weight"], b["n_docs"], b["n_words"])
            for i in best:
                a, e = b["first"][i], b["first"][i + 1]
                best[i] = best_of(inverted, b["terms"][a:e], b["repeats"][a:e], best[i], top)
        rows = [(b["items"][i], doc, score) for i, found in best.items() for score, doc in found]
        if rows:
            item, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, kind), pa.array(score, pa.int64())], ["item", "doc_id", "score"])
    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score) from items (item_id, text) over docs (doc_id, text)."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    ship(spark)
    asked = cut_lineage(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()))
    wanted = cut_lineage(asked.select("item", F.explode(terms(F.col("text"))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("repeats")))
    blocks = -(-wanted.count() // block)
    found = spark.createDataFrame([], f"item long, doc_id {kind}, score long")
    for i in range(blocks):
        some = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).orderBy("item", "term").toPandas()  # one block of the queries
        if not len(some):
            continue
        words = sorted(set(some["term"]))
        number = {w: t for t, w in enumerate(words)}
        counts = cut_lineage(term_counts(docs, spark.sparkContext.broadcast(words)))
        n_docs, n_words = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        df = np.zeros(len(words), np.int64)
        for t, n in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # a row a term of the block
            df[t] = n
        item = some["item"].to_numpy(np.int64)
        first = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1], [True])))
        held = {"items": item[first[:-1]].tolist(), "first": first, "terms": some["term"].map(number).to_numpy(np.int64), "repeats": some["repeats"].to_numpy(np.int64),
                "weight": np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64), "n_docs": n_docs, "n_words": n_words}
        part = counts.mapInArrow(_candidates(spark.sparkContext.broadcast(held), top), f"item long, doc_id {kind}, score long")
        found = found.unionByName(cut_lineage(part))
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    few = found.withColumn("place", F.row_number().over(Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES))).orderBy(*order))).where(F.col("place") <= top).drop("place")
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    return few.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13(spark, d: str) -> DataFrame:
    return search(table(d, "documents", spark), table(d, "benchmark", spark))


OP13_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS ws FROM documents),
items AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS ws FROM benchmark),
wanted AS (SELECT i, term, count(*) AS c FROM (SELECT i, unnest(ws) AS term FROM items) GROUP BY i, term),
lens AS (SELECT r, doc_id, len(ws) AS n FROM docs WHERE len(ws) > 0),
totals AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nw FROM lens),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
shares AS (
  SELECT t.r, t.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nd) // nw)))) AS s
  FROM tf t JOIN weights USING (term) JOIN lens USING (r), totals),
scored AS (SELECT i, r, CAST(sum(c * s) AS BIGINT) AS score FROM wanted JOIN shares USING (term) GROUP BY i, r),
ranked AS (
  SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank
  FROM scored JOIN lens USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN items USING (i) WHERE rank <= {TOP}
"""
