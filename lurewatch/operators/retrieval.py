"""Exact nearest neighbours by blocks: Spark pairs blocks of vectors, numpy multiplies them, only k rows per query leave
a block pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.operators.skew import top_per_group

BLOCK, LEAST, STRIP = 1 << 14, 1024, 512
MIN_SIM = 0.45


def normalised(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """The index: unit vectors as ARRAY<FLOAT>; zero vectors are left out."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.withColumn("_n", norm).where("_n > 0").withColumn(vec, F.transform(vec, lambda x: (x / F.col("_n")).cast("float"))).drop("_n")


def _best(k: int, min_sim: float):
    """A function that workers get by value: (query, neighbour, similarity) of the k best columns of each row that reach min_sim,
    never the query itself."""
    def best(sims: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> tuple[np.ndarray, ...]:
        hit = (sims >= min_sim) & (qi[:, None] != xi[None, :])
        if np.count_nonzero(hit) > 8 * k * len(sims) and k < sims.shape[1]:
            hit &= sims >= np.partition(np.where(hit, sims, -2.0), -k, axis=1)[:, -k, None]
        row, col = np.nonzero(hit)
        sim = sims[row, col]
        order = np.lexsort((xi[col], -sim, row))
        row, col, sim = row[order], col[order], sim[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        return qi[row[first]], xi[col[first]], sim[first]
    return best


def knn(queries: DataFrame, index: DataFrame, k: int, min_sim: float = MIN_SIM, block: int = BLOCK, total: int | None = None) -> DataFrame:
    """(query_id, neighbour_id, similarity, rank): the k nearest index rows of each query, never the query itself.

    Both sides hold id and embedding. Rows are hashed into blocks of about `block` rows and every query block meets
    every index block once, in its own task. The product is the operator's own cost; what leaves a task is at most k
    rows per query, so the second ranking sees k x blocks rows, not pairs.
    """
    nq = max(1, -(-(queries.count()) // block))
    ni = max(1, -(-(total if total is not None else index.count()) // block))
    q = queries.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(nq)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(ni - 1))).alias("ib"))
    x = index.select(F.col("id").alias("xid"), F.col("embedding").alias("xe"), F.pmod(F.xxhash64("id"), F.lit(ni)).cast("int").alias("xib"),
                     F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("xqb"))
    q = q.withColumn("qb", F.col("qb").cast("int"))

    best = _best(k, min_sim)

    def block_top(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["query_id", "neighbour_id", "similarity"]
        if left.empty or right.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64" if c != "similarity" else "float64") for c in cols})
        a = np.stack(left["embedding"].to_numpy()).astype("float64")
        b = np.stack(right["xe"].to_numpy()).astype("float64")
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        qi, xi = left["id"].to_numpy(), right["xid"].to_numpy()
        found = [best(a[low: low + STRIP] @ b.T, qi[low: low + STRIP], xi) for low in range(0, len(a), STRIP)]
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(cols, zip(*found))})

    met = q.groupBy("qb", "ib").cogroup(x.groupBy("xqb", "xib")).applyInPandas(block_top, "query_id bigint, neighbour_id bigint, similarity double")
    return top_per_group(met, ["query_id"], [F.desc("similarity"), F.col("neighbour_id")], k, F.col("neighbour_id"), parts=4)


def twins(df: DataFrame, keep: int = 320, min_sim: float = 0.55) -> DataFrame:
    """Each hostile row's nearest benign row; the best `keep` pairs at or above min_sim."""
    near = knn(df.where("label = 1"), df.where("label = 0"), 1, min_sim)
    return near.select(F.col("query_id").alias("malicious"), F.col("neighbour_id").alias("benign"), "similarity").orderBy(
        F.desc("similarity"), "malicious").limit(keep)


def hashed_embedding(df: DataFrame, text: str, dims: int = 256) -> DataFrame:
    """A static hashed-token embedding: term counts hashed to `dims` slots, then L2-normalised, all in Spark ML."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array
    stages = [RegexTokenizer(inputCol="_t", outputCol="_w", pattern="[^a-z0-9']+"), HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dims),
              Normalizer(inputCol="_tf", outputCol="_v")]
    df = df.withColumn("_t", F.left(F.col(text), F.lit(2000)))
    out = Pipeline(stages=stages).fit(df).transform(df)
    return out.withColumn("embedding", vector_to_array("_v", "float32")).drop("_t", "_w", "_tf", "_v")
