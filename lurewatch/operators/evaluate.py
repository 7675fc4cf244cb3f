"""Evaluation as SQL aggregates over (y, p) rows. Scores are grouped before they are ranked, never collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.operators.skew import in_ranges

THRESHOLDS = (0.5, 0.7, 0.8, 0.9, 0.95, 0.99)


def marker_precision(df: DataFrame, label: str, markers: dict[str, Column]) -> DataFrame:
    """Per marker: rows hit by class and precision among the hits. One pass, one row out, then unpivoted."""
    bad = F.col(label) == 1
    aggs = []
    for m, c in markers.items():
        aggs += [F.count_if(c & bad).alias(f"{m}__b"), F.count_if(c & ~bad).alias(f"{m}__g")]
    one = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(m).alias("marker"), F.col(f"{m}__b").alias("malicious"), F.col(f"{m}__g").alias("benign")) for m in markers])
    out = one.select(F.explode(pairs).alias("m")).select("m.*")
    n = F.col("malicious") + F.col("benign")
    return out.withColumn("precision", F.when(n > 0, F.col("malicious") / n).otherwise(F.lit(0.0)))


def _by_score(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct score (and key) with positive and negative counts."""
    return df.groupBy(*keys, "p").agg(F.sum("y").cast("bigint").alias("pos"), F.sum(1 - F.col("y")).cast("bigint").alias("neg"))


def roc_auc(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Tie-aware ROC-AUC: each positive beats the negatives below it and half of those at the same score."""
    keys = keys or []
    g = _prefix_scores(_by_score(df, keys), keys)
    agg = g.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("wins"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return agg.select(*keys, "n_pos", "n_neg", F.when(
        (F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def _prefix_scores(g: DataFrame, keys: list[str]) -> DataFrame:
    """Add pos_below, neg_below: counts at strictly smaller scores. Scores are cut into ranges of about equal size, so piled-up scores
    spread too, and the only window over a whole key runs on a row per range."""
    g = in_ranges(g, [*keys, "p"])
    per = g.groupBy(*keys, "_b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_b", F.coalesce(F.sum("bp").over(w), F.lit(0)).alias("ep"), F.coalesce(F.sum("bn").over(w), F.lit(0)).alias("en"))
    v = Window.partitionBy(*keys, "_b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    g = g.select("*", F.coalesce(F.sum("pos").over(v), F.lit(0)).alias("ip"), F.coalesce(F.sum("neg").over(v), F.lit(0)).alias("in_"))
    out = g.join(per, [*keys, "_b"])
    return out.select(*keys, "p", "pos", "neg", (F.col("ep") + F.col("ip")).alias("pos_below"), (F.col("en") + F.col("in_")).alias("neg_below"))


def average_precision(df: DataFrame) -> DataFrame:
    """Area under the precision-recall curve by steps: precision at each score times the positives found there."""
    g = _prefix_scores(_by_score(df, []), [])
    tot = g.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    g = g.withColumn("one", F.lit(1)).join(F.broadcast(tot.withColumn("one", F.lit(1))), "one")
    tp = F.col("all_pos") - F.col("pos_below")
    seen = tp + F.col("all_neg") - F.col("neg_below")
    return g.agg(F.sum(F.col("pos") * tp / seen / F.col("all_pos")).alias("average_precision"))


def confusion(df: DataFrame, threshold: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    hit, bad = F.col("p") >= threshold, F.col("y") == 1
    out = df.groupBy(*(keys or [])).agg(F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn"), F.count_if(~hit & ~bad).alias("tn"))
    return with_rates(out)


def with_rates(df: DataFrame) -> DataFrame:
    def part(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return df.withColumns({
        "precision": part(F.col("tp"), F.col("tp") + F.col("fp")), "recall": part(F.col("tp"), F.col("tp") + F.col("fn")),
        "fpr": part(F.col("fp"), F.col("fp") + F.col("tn"))})


def operating_points(df: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """One pass for all thresholds: each row is counted at every threshold by conditional sums, then unpivoted."""
    bad = F.col("y") == 1
    aggs = []
    for i, t in enumerate(thresholds):
        hit = F.col("p") >= t
        aggs += [F.count_if(hit & bad).alias(f"tp{i}"), F.count_if(hit & ~bad).alias(f"fp{i}"), F.count_if(~hit & bad).alias(f"fn{i}"), F.count_if(~hit & ~bad).alias(f"tn{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), *[F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "fn", "tn")]) for i, t in enumerate(thresholds)])
    return with_rates(one.select(F.explode(rows).alias("r")).select("r.*"))


def calibration_bins(df: DataFrame, min_rows: int = 20) -> DataFrame:
    """Predicted against observed in ten bins; p = 1 falls outside them."""
    out = df.where("p < 1").groupBy(F.floor(F.col("p") * 10).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg(F.col("y").cast("double")).alias("observed"))
    return out.where(F.col("n") >= min_rows)


def class_report(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from the (true, predicted) counts."""
    cells = df.groupBy(F.col(true).alias("t"), F.col(pred).alias("q")).agg(F.count("*").alias("n"))
    support = cells.groupBy(F.col("t").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("q"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = cells.groupBy(F.col("q").alias("cls")).agg(F.sum("n").alias("predicted"))
    out = support.join(predicted, "cls", "full").na.fill(0, ["support", "tp", "predicted"])
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    return out.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(
        F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))


def exact_percentiles(df: DataFrame, keys: list[str], value: Column, bucket, points: list[float]) -> DataFrame:
    """(keys, pos, value): interpolated percentiles from value counts ranked in two steps. `bucket` maps the value column
    to a slice that grows with it; no task ever holds all values of a key."""
    counted = df.select(*keys, value.cast("double").alias("_x")).where("_x IS NOT NULL").groupBy(*keys, "_x").agg(F.count("*").alias("_n")).withColumn("_b", bucket(F.col("_x")))
    per, slices, inside = counted.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m")), Window.partitionBy(*keys).orderBy("_b"), Window.partitionBy(*keys, "_b").orderBy("_x")

    def below(c, w):
        return F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("_i", below("_n", inside)).join(per.select(*keys, "_b", below("_m", slices).alias("_e")), [*keys, "_b"]).withColumn("_before", F.col("_e") + F.col("_i"))
    total = counted.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    at = F.array(*[F.struct(F.lit(i).alias("pos"), (F.lit(float(p)) * (F.col("_all") - 1)).alias("r")) for i, p in enumerate(points)])

    def here(rank):
        return (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_n"))
    met = placed.join(total, keys).select(*keys, "_x", F.explode(F.filter(at, lambda s: here(F.floor(s.r)) | here(F.ceil(s.r)))).alias("s"))
    low, high, part = F.min("_x"), F.max("_x"), F.first("s.r") - F.floor(F.first("s.r"))
    return met.groupBy(*keys, F.col("s.pos").alias("pos")).agg((low + part * (high - low)).alias("value"))
