"""Toxic spans and document scores by a two-state linear-chain conditional random field.

Fit, on a bounded hash-ordered sample of labelled rows outside the held-out fold (SAMPLE_TOXIC and SAMPLE_CLEAN rows):
words (ASCII letters lowered, punctuation apart) that mark toxic documents by a likelihood-ratio test form a lexicon of at
most LEXICON entries, graded by log-odds. Tokens of toxic rows in the lexicon are labelled T, all others O; sequences
around such tokens and plain ones train emissions (own, previous and next grade) and transitions by forward-backward
gradients. A small logistic model maps the chain's marginals to a document score.

Scoring reads every whole text. Tokens without any graded word beside them share one transfer matrix, so stretches of them
are exact matrix powers and the chain is walked over the few others only. Marginals aggregate to (largest, expected
count), the score, and the byte offsets of the offending tokens.

Only the text is an input of a score. Null and empty texts get the score of a text without marked words. Without usable
labels the lexicon is empty and the score is the smoothed base rate. Several label rows of one document count as toxic if
one says so; null labels are ignored. Empty tables give no rows; repeated rows each give theirs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import U64, Words, batches, flat, table
from lurewatch.session import cut_lineage

SAMPLE_TOXIC, SAMPLE_CLEAN, LEXICON = 4096, 8192, 2048
LEAST_RATIO, LEAST_DOCS, THRESHOLD = 20.0, 4, 0.7
GRADES = (1.5, 3.0, 4.5)  # log-odds that part grades 1..4; grade 0 is no lexicon word
SPAN, PER_DOC = 8, 4  # training sequences: tokens on each side, and at most so many a document
SLICE = 2048  # sequences in memory at once while fitting

_IS_TOKEN = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)], bool)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; 1 is held out. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def tokens(texts: pa.Array) -> Words:
    buf, offsets = flat(texts)
    return Words(_LOWER[buf], offsets, _IS_TOKEN)


# ---- the chain
class Chain:
    """Weights: own (5 grades), before (5), after (5) for state T against O, transitions [O, T] x [O, T], start of T."""

    def __init__(self, weights: np.ndarray) -> None:
        self.w = weights
        self.own, self.before, self.after = weights[0:5], weights[5:10], weights[10:15]
        self.trans, self.start = np.exp(np.array([[0.0, weights[15]], [0.0, weights[16]]])), weights[17]

    def emission(self, own, before, after):
        return self.own[own] + self.before[before] + self.after[after]

    def marginals(self, u: np.ndarray, gap: np.ndarray, tail: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(T) of chain tokens: u their emissions, gap the plain tokens before each, tail those after a text's last."""
        plain = float(np.exp(self.emission(0, 0, 0)))
        k = self.trans * np.array([1.0, plain])
        values, vectors = np.linalg.eig(k)
        order = np.argsort(-values.real)
        values, vectors = values.real[order], vectors.real[:, order]
        inverse = np.linalg.inv(vectors)
        low, high = np.outer(vectors[:, 0], inverse[0]), np.outer(vectors[:, 1], inverse[1])

        def power(n):
            return low + high * ((values[1] / values[0]) ** n)[:, None, None]
        e = np.exp(np.clip(u, -30, 30))
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        ahead, back = np.ones((len(u), 2)), np.ones((len(u), 2))
        # the start: a text begins in O or T by the start weight; g plain tokens may come first
        begin = np.array([1.0, np.exp(self.start)])
        state = np.zeros((len(order), 2))
        for t in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -t, "left"))
            i = first[order[:m]] + t
            if t == 0:
                g = gap[i]
                # the first token of the text takes the start weights, each later one a transition
                lead = np.where((g > 0)[:, None], begin * np.array([1.0, plain]), 0.0)
                lead = np.einsum("bi,bij->bj", lead, power(np.maximum(g - 1, 0)))
                v = np.where((g > 0)[:, None], lead @ self.trans, begin)
            else:
                v = np.einsum("bi,bij->bj", state[:m], power(gap[i])) @ self.trans
            v = v * np.stack([np.ones(m), e[i]], 1)
            v /= v.sum(1, keepdims=True)
            ahead[i], state[:m] = v, v
        state = np.ones((len(order), 2))
        for t in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
            m = int(np.searchsorted(-size, -t, "left"))
            i = first[order[:m]] + t
            last = size[:m] == t + 1
            nxt = np.minimum(i + 1, len(u) - 1)
            after = np.einsum("bij,bj->bi", power(np.where(last, tail[order[:m]], gap[nxt])), np.where(last[:, None], 1.0, (state[:m] * np.stack([np.ones(m), e[nxt]], 1)) @ self.trans.T))
            after /= after.sum(1, keepdims=True)
            back[i], state[:m] = after, after
        both = ahead * back
        return both[:, 1] / both.sum(1)


def fit_chain(grades: np.ndarray, tagged: np.ndarray, rounds: int = 150, rate: float = 0.2, ridge: float = 0.02) -> np.ndarray:
    """Adam on the conditional likelihood. grades: sequences x (length + 2), with one token of context on each side;
    tagged: sequences x length of 0 (O) and 1 (T)."""
    w = np.zeros(18)
    w[0] = -2.0
    if not len(grades):
        return w
    m1, m2 = np.zeros(18), np.zeros(18)
    for step in range(1, rounds + 1):
        g = sum(_gradient(Chain(w), grades[a: a + SLICE], tagged[a: a + SLICE]) for a in range(0, len(grades), SLICE)) / len(grades) - ridge * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w = w + rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    return w


def _gradient(c: Chain, grades: np.ndarray, tagged: np.ndarray) -> np.ndarray:
    """Seen minus expected feature counts of some sequences, by forward-backward."""
    own, before, after = grades[:, 1:-1], grades[:, :-2], grades[:, 2:]
    n, length = tagged.shape
    e = np.exp(c.emission(own, before, after))
    ahead, back = np.ones((length, n, 2)), np.ones((length, n, 2))
    v = np.stack([np.ones(n), e[:, 0] * np.exp(c.start)], 1)
    for t in range(length):
        if t:
            v = (ahead[t - 1] @ c.trans) * np.stack([np.ones(n), e[:, t]], 1)
        ahead[t] = v / v.sum(1, keepdims=True)
    for t in range(length - 2, -1, -1):
        b = (back[t + 1] * np.stack([np.ones(n), e[:, t + 1]], 1)) @ c.trans.T
        back[t] = b / b.sum(1, keepdims=True)
    both = ahead * back
    left = tagged - (both[:, :, 1] / both.sum(2)).T
    g = np.zeros(18)
    for base, feature in ((0, own), (5, before), (10, after)):
        g[base: base + 5] = np.bincount(feature.ravel(), left.ravel(), 5)
    pair = ahead[:-1, :, :, None] * c.trans[None, None] * (np.stack([np.ones_like(e), e], 2).transpose(1, 0, 2)[1:] * back[1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    g[15] = ((1 - tagged[:, :-1]) * tagged[:, 1:]).sum() - pair[:, :, 0, 1].sum()
    g[16] = (tagged[:, :-1] * tagged[:, 1:]).sum() - pair[:, :, 1, 1].sum()
    g[17] = left[:, 0].sum()
    return g


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penal = np.full(len(w), ridge)
        penal[0] = 1e-6
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penal + 1e-9)
        step = np.linalg.solve(h, x.T @ (y - p) - penal * w)
        w = w + np.clip(step, -2, 2)
    return w


class Model:
    """names: sorted 64-bit names of lexicon words; grades: 1..4 of each; chain weights; logistic weights."""

    def __init__(self, names: np.ndarray, grades: np.ndarray, chain: np.ndarray, logistic: np.ndarray) -> None:
        self.names, self.grades, self.chain, self.logistic = names, grades, chain, logistic

    def graded(self, words: Words) -> np.ndarray:
        own = np.zeros(len(words.start), np.int64)
        if len(self.names) and len(own):
            name = words.names()
            at = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
            hit = self.names[at] == name
            own[hit] = self.grades[at[hit]]
        return own

    def evidence(self, words: Words):
        """(largest marginal, expected toxic tokens) per text; and (token, marginal) of the chain tokens."""
        count = len(words.first) - 1
        own = self.graded(words)
        hits = np.flatnonzero(own)
        if not len(hits):
            return np.zeros(count), np.zeros(count), hits, np.zeros(0)
        doc_of = np.searchsorted(words.first, hits, "right") - 1
        near = np.unique(np.concatenate((hits, np.maximum(hits - 1, words.first[doc_of]), np.minimum(hits + 1, words.first[doc_of + 1] - 1))))
        doc = np.searchsorted(words.first, near, "right") - 1
        has_l, has_r = near > words.first[doc], near + 1 < words.first[doc + 1]
        before = np.where(has_l, own[np.maximum(near - 1, 0)], 0)
        after = np.where(has_r, own[np.minimum(near + 1, len(own) - 1)], 0)
        chain = Chain(self.chain)
        first = np.searchsorted(doc, np.arange(count + 1))
        gap = near - np.concatenate(([0], near[:-1] + 1))
        head = first[:-1][np.diff(first) > 0]
        gap[head] = near[head] - words.first[doc[head]]
        tail = np.zeros(count, np.int64)
        full = np.flatnonzero(np.diff(first) > 0)
        tail[full] = words.first[full + 1] - near[first[full + 1] - 1] - 1
        p = chain.marginals(chain.emission(own[near], before, after), gap, tail, first)
        most, total = np.zeros(count), np.zeros(count)
        np.maximum.at(most, doc, p)
        np.add.at(total, doc, p)
        return most, total, near, p

    @staticmethod
    def design(most: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.stack([np.ones(len(most)), most, np.log1p(total)], 1)

    def scores(self, most: np.ndarray, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(most, total) @ self.logistic, -30, 30)))


# ---- fitting on the bounded sample
def training_sample(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> DataFrame:
    """(text, toxic) of at most `toxic` + `clean` labelled documents outside the held-out fold, by hash order."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold(F.col("doc_id")) != 1)
    marks = cut_lineage(marks.withColumn("h", F.xxhash64("doc_id")))
    picked = cut_lineage(marks.where("toxic = 1").orderBy("h", "doc_id").limit(toxic).unionByName(marks.where("toxic = 0").orderBy("h", "doc_id").limit(clean)))
    return cut_lineage(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked.select("doc_id", "toxic")), "doc_id").select("text", "toxic"))


def _token_names(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = tokens(batch.column(0))
    doc = words.doc().astype(np.int64)
    name = words.names().view(np.int64)
    order = np.lexsort((name, doc))
    name, doc = name[order], doc[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    return pa.RecordBatch.from_arrays([pa.array(name[new]), batch.column(1).take(pa.array(doc[new]))], ["name", "toxic"])


def lexicon(sample: DataFrame, size: int = LEXICON) -> tuple[np.ndarray, np.ndarray]:
    """(sorted names, grades 1..4) of the words whose documents are toxic far more often than the sample's."""
    bad, good = (sample.where(f"toxic = {v}").count() for v in (1, 0))
    if not bad or not good:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    per = batches(sample.select("text", F.col("toxic").cast("int").alias("toxic")), _token_names, "name long, toxic int").groupBy("name").agg(
        F.sum(F.col("toxic").cast("long")).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    share = bad / (bad + good)
    n = F.col("t") + F.col("c")
    ratio = 2 * (F.col("t") * F.log(F.col("t") / (n * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - share)))).otherwise(0.0))
    odds = F.log(((F.col("t") + 0.5) / (bad + 1)) / ((F.col("c") + 0.5) / (good + 1)))
    top = per.where(F.col("t") >= LEAST_DOCS).select("name", ratio.alias("ratio"), odds.alias("odds")).where((F.col("ratio") >= LEAST_RATIO) & (F.col("odds") > 0))
    rows = top.orderBy(F.desc("ratio"), "name").limit(size).collect()
    names = np.array([r["name"] for r in rows], np.int64).view(U64)
    grades = 1 + np.searchsorted(GRADES, np.array([r["odds"] for r in rows], float))
    order = np.argsort(names)
    return names[order], grades[order]


def _sequences(model: Model):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = tokens(batch.column(0))
        own, toxic = model.graded(words), np.asarray(batch.column(1))
        seqs, tags = [], []
        for i in range(batch.num_rows):
            g = own[words.first[i]: words.first[i + 1]]
            if not len(g):
                continue
            hits = np.flatnonzero(g)
            at = hits[np.linspace(0, len(hits) - 1, min(PER_DOC, len(hits))).astype(int)] if len(hits) else np.array([len(g) // 2])
            wide = np.concatenate((np.zeros(SPAN + 1, np.int64), g, np.zeros(SPAN + 1, np.int64)))
            for a in at:
                s = wide[a: a + 2 * SPAN + 3]
                seqs.append(s.astype(np.int8).tobytes())
                tags.append(((s[1:-1] > 0) & (toxic[i] == 1)).astype(np.int8).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(seqs, pa.binary()), pa.array(tags, pa.binary())], ["grades", "tags"])
    return work


def _evidence(model: Model):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        most, total, _, _ = model.evidence(tokens(batch.column(0)))
        return pa.RecordBatch.from_arrays([pa.array(most), pa.array(total), batch.column(1)], ["most", "total", "toxic"])
    return work


def fit(docs: DataFrame, labels: DataFrame, **sizes) -> Model:
    sample = training_sample(docs, labels, **sizes).select("text", F.col("toxic").cast("int").alias("toxic"))
    names, grades = lexicon(sample)
    model = Model(names, grades, fit_chain(np.zeros((0, 0)), np.zeros((0, 0))), np.zeros(3))
    if len(names):
        # at most PER_DOC small sequences for each of the bounded sample's rows, as bytes
        seqs = batches(sample, _sequences(model), "grades binary, tags binary").collect()
        grades, tags = (np.frombuffer(b"".join(bytes(r[i]) for r in seqs), np.int8).reshape(len(seqs), -1 if seqs else 1) for i in (0, 1))
        model.chain = fit_chain(grades, tags)
        del seqs, grades, tags
    rows = np.array(batches(sample, _evidence(model), "most double, total double, toxic int").collect(), float).reshape(-1, 3)
    model.logistic = fit_logistic(Model.design(rows[:, 0], rows[:, 1]), rows[:, 2]) if len(rows) else np.array([-2.0, 0.0, 0.0])
    return model


def score(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """(doc_id, score [, spans array<struct<start, end, p>>]): byte offsets of tokens with a marginal of 0.5 or more."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, score double" + ", spans array<struct<start:long,end:long,p:double>>" * spans

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = tokens(batch.column(1))
        most, total, near, p = model.evidence(words)
        columns, names = [batch.column(0), pa.array(model.scores(most, total))], ["doc_id", "score"]
        if spans:
            _, offsets = flat(batch.column(1))
            take = np.flatnonzero(p >= 0.5)
            doc = np.searchsorted(words.first, near[take], "right") - 1
            parts = [pa.array(words.start[near[take]] - offsets[doc]), pa.array(words.end[near[take]] - offsets[doc]), pa.array(p[take])]
            columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)), pa.StructArray.from_arrays(parts, ["start", "end", "p"])))
            names.append("spans")
        return pa.RecordBatch.from_arrays(columns, names)
    return batches(docs.select("doc_id", "text"), work, schema)


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score stays below the threshold, all columns as they are."""
    model, at = fit(docs, labels), docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        most, total, _, _ = model.evidence(tokens(batch.column(at)))
        return batch.filter(pa.array(model.scores(most, total) < threshold))
    return batches(docs, work, docs.schema)


def op9(spark, d: str) -> DataFrame:
    docs = table(d, "documents", spark)
    out = score(docs, fit(docs, table(d, "labels", spark)))
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
