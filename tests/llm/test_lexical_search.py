"""Ranked lexical search against a plain version: every document scored for every item."""

import math
import random
import re
from collections import Counter

import pytest

from lurewatch.llm import lexical_search as LS

LOWER = str.maketrans(LS.UPPER, LS.LOWER)
DOCS = "doc_id long, text string, term string, item long, score string, n int"
ITEMS = "item_id string, text string, item string, doc_id int"


def words(text):
    return re.findall(LS.TERM, (text or "").translate(LOWER))


def plain(docs, items, top=20):
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(words(text)), []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in asked.items() if t in c)
            if score > 0:
                found.append((-score, i is not None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(found[:top])]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in docs], DOCS), spark.createDataFrame([(i, t, "z", 3) for i, t in items], ITEMS))


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"] and dict(df.dtypes)["rank"] == "int"
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(150)] + ["Été", "ÉTÉ", "naïve", "Don't", "x-y", "A1"]

    def prose(n):
        return " ".join(vocabulary[min(int(rng.paretovariate(0.6)) - 1, len(vocabulary) - 1)] for _ in range(n))

    docs = [(i, prose(rng.choice((1, 4, 30, 90)))) for i in range(260)]
    docs += [(300 + i, docs[5][1]) for i in range(40)] + [(5, docs[5][1])] * 3  # ties and repeated rows
    docs += [(400, None), (401, ""), (402, " .,! "), (None, docs[5][1]), (403, prose(9000)), (404, "W1 w1\tW1"), (405, "\x00w2\x7fw3")]
    items = [(f"i{i}", prose(rng.choice((1, 3, 12, 100)))) for i in range(25)]
    items += [("i3", "w1 w2"), ("none", None), ("empty", ""), (None, "été W7 don t"), ("same", "w9 w9 w9 w12"), ("same", "w9 w9 w9 w12"), ("unknown", "qqq zzz"),
              ("wide", " ".join(f"w{i} w{i // 2}" for i in range(150)))]
    return docs, items


def test_search(spark, corpus):
    docs, items = corpus
    d, i = frames(spark, docs, items)
    assert got(LS.search(d.repartition(5), i)) == plain(docs, items)


def test_blocks_of_items_and_small_batches(spark, corpus):
    docs, items = corpus
    d, i = frames(spark, docs, items)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert got(LS.search(d.repartition(3), i, top=4, block=120)) == plain(docs, items, 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_tables(spark, corpus):
    docs, items = corpus
    d, i = frames(spark, docs, items)
    nothing, none = frames(spark, [], [])
    assert got(LS.search(nothing, i)) == [] == got(LS.search(d, none))
    assert got(LS.search(*frames(spark, [(1, None), (2, "")], [("a", "w1")]))) == []
    assert got(LS.search(*frames(spark, [(1, "w1")], [("a", "w1")]))) == plain([(1, "w1")], [("a", "w1")])


def test_groups_that_cannot_reach_the_best_are_left_out(spark, monkeypatch):
    """The search stops early: most documents are never scored."""
    import numpy as np
    import pyarrow as pa
    rng, seen = random.Random(6), []
    n, terms = 4000, np.arange(6)
    lists = [sorted(rng.sample(range(6), rng.choice((1, 1, 1, 2, 2, 6 if i % 50 == 0 else 1)))) for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([50] * n, pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array([[1] * len(x) for x in lists], pa.list_(pa.int32()))],
                                       ["doc_id", "n", "terms", "times"])
    weight = np.array([900, 700, 500, 300, 200, 100])
    b = LS.Batch(batch, weight, n, 50 * n)
    monkeypatch.setattr(LS.Batch, "scores", lambda self, docs, *a, f=LS.Batch.scores: (seen.append(len(docs)), f(self, docs, *a))[1])
    found = LS.best_of(b, terms, np.ones(6, np.int64), [], 20)
    want = sorted((-int(sum(LS.share(weight[t], np.array(1), np.array(100)) for t in x)), i) for i, x in enumerate(lists))[:20]
    assert [(-s, i) for s, i in found] == want and sum(seen) < n / 10
