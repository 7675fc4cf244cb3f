"""Quality rules with risk-controlled thresholds.

Each rule is a ratio and a cutoff: symbols per word character, repeated lines per line, repeated words per word. A cutoff
is admissible in a stratum (language) if the labelled good documents show, by an exact binomial test, that it rejects at
most `risk` of the stratum's good documents. Every (stratum, rule, cutoff) of the grid is one test and they share the
error `delta` (Bonferroni), so the choice among admissible cutoffs may look at the data: it is the one that rejects most
bad minus good labelled documents, the mildest in ties. Then with probability 1 - delta no stratum loses more than
`risk` of its good documents by any rule. A stratum with too few labels to prove this gets no cutoff and keeps everything
that passes the base rules.

Texts are counted once; labelled counts are folded to at most len(CUTS) + 1 rows per (stratum, rule) before they meet.

Null texts have no words and fail the base rule; a null stratum is one of its own; a document with several label rows is
good if any says so; labels of unknown documents do nothing. Empty tables give no rows; repeated rows each give theirs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import BASES, U64, Words, batches, flat, mix, table
from lurewatch.session import cut_lineage

RISK, DELTA = 0.01, 0.05
#: Cutoffs tried for every rule.
CUTS = (0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1, 0.125, 0.15, 0.175, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.8)
RULES = ("symbols", "lines", "words")
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = 1
_STARTS_CHAR = np.array([(b & 0xC0) != 0x80 for b in range(256)], bool)


def repeated_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """Per text, the words inside a window of words that the same text holds twice or more."""
    doc = words.doc()
    n, count = len(doc), len(words.first) - 1
    if n < window:
        return np.zeros(count, np.int64)
    names = words.names()
    at = np.arange(n - window + 1)
    at = at[doc[at] == doc[at + window - 1]]
    key = mix(doc[at].astype(U64))
    with np.errstate(over="ignore"):
        for k in range(window):
            key = mix(key * BASES[1] + names[at + k])
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    at = at[times[back] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    return covered[words.first[1:]] - covered[words.first[:-1]]


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch.column(2)
    buf, offsets = flat(texts)
    words = Words(buf, offsets)

    def per_text(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[offsets[1:]] - sums[offsets[:-1]]
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[words.start] += 1
    np.add.at(inside, words.end, -1)
    chars = per_text((np.cumsum(inside[:-1]) > 0) & _STARTS_CHAR[buf])
    lines, repeated = [], []
    for t in texts.to_pylist():
        held = [x for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
        lines.append(len(held))
        repeated.append(len(held) - len(set(held)))
    columns = [np.diff(words.first), chars, per_text(_IS_SYMBOL[buf]), repeated, repeated_words(words), lines]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "stratum", *names])


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of whole texts."""
    kinds = dict(docs.dtypes)
    counts = ", ".join(f"{n} long" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"))
    return batches(docs.select("doc_id", F.col(stratum).alias("stratum"), "text"), _features, f"doc_id {kinds['doc_id']}, stratum {kinds[stratum]}, {counts}")


def _with_ratios(df: DataFrame) -> DataFrame:
    one = F.lit(1)
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return df.withColumns({"r_symbols": F.col("n_symbols") / F.greatest("word_chars", one), "r_lines": F.col("n_dup_lines") / F.greatest("n_lines", one),
                           "r_words": F.col("n_repeat_words") / F.greatest("n_words", one), "skey": F.coalesce(F.concat(F.lit("="), "stratum"), F.lit(""))})


def at_most(x: int, n: int, p: float) -> float:
    """Exact P(Binomial(n, p) <= x)."""
    if x >= n:
        return 1.0
    base = math.lgamma(n + 1)
    return min(1.0, math.fsum(math.exp(base - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(x + 1)))


def _choose(level: float, risk: float, cuts: tuple):
    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        above = rows.groupby("above")[["good", "bad"]].sum().reindex(range(len(cuts) + 1), fill_value=0)
        n = int(above["good"].sum())
        lost = above["good"][::-1].cumsum()[::-1]  # good documents above the first j cutoffs
        caught = above["bad"][::-1].cumsum()[::-1]
        fit = [j for j in range(1, len(cuts) + 1) if lost[j] <= risk * n and at_most(int(lost[j]), n, risk) <= level]
        best = max(fit, key=lambda j: (caught[j] - lost[j], j), default=None)
        row = rows.iloc[0]
        return pd.DataFrame({"skey": [row["skey"]], "rule": [row["rule"]], "cut": [cuts[best - 1] if best else None], "good": [n],
                             "lost": [int(lost[best]) if best else None], "caught": [int(caught[best]) if best else None]})
    return choose


def thresholds(feats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, cuts: tuple = CUTS) -> tuple[DataFrame, int]:
    """((skey, rule, cut, good, lost, caught), number of strata); cut is null where nothing can be proven."""
    marks = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = feats.where(~F.col("base_failed")).join(marks, "doc_id")
    grid = F.array(*[F.lit(float(c)) for c in cuts])

    def above(ratio):
        return F.size(F.filter(grid, lambda c: F.col(ratio) > c))
    level = F.array(*[F.struct(F.lit(r).alias("rule"), above(f"r_{r}").alias("above")) for r in RULES])
    rows = held.select("skey", "quality", F.explode(level).alias("l")).groupBy("skey", "l.rule", "l.above").agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    rows = cut_lineage(rows)
    strata = rows.select("skey").distinct().count()
    chosen = rows.groupBy("skey", "rule").applyInPandas(_choose(delta / max(1, strata * len(RULES) * len(cuts)), risk, cuts),
                                                        "skey string, rule string, cut double, good long, lost long, caught long")
    return chosen, strata


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **kw) -> DataFrame:
    """The features of every document, base_failed, and kept."""
    feats = _with_ratios(cut_lineage(features(docs, stratum)))
    chosen, strata = thresholds(feats, labels, **kw)
    wide = chosen.groupBy("skey").agg(*[F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{r}") for r in RULES])
    if strata <= 10_000:  # a row a stratum: proven small; above this Catalyst chooses
        wide = F.broadcast(wide)
    df = feats.join(wide, "skey", "left")
    passes = ~F.col("base_failed")
    for r in RULES:
        passes = passes & F.coalesce(F.col(f"r_{r}") <= F.col(f"cut_{r}"), F.lit(True))
    return df.withColumn("kept", passes)


def op3(spark, d: str) -> DataFrame:
    return judge(table(d, "documents", spark), table(d, "labels", spark)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
