"""The model in the score: how likely a message is malicious, and of which vector, fitted on labelled mail.

Two views of a message are sets of marks: its words (wording) and the features above zero (structure). A mark's weight is its
smoothed log-count ratio, kept where its shares of the two classes stand Z standard errors apart. The two sums of weights are blended by
a linear discriminant (two means, one pooled covariance) and calibrated by label rates at 17 knots of the blended score, made
monotone, with straight lines in between.

Everything is cross-fitted: a message belongs to the fold of its content, and weights, blend and calibration of a fold come from the
other folds only. Copies of a text share a fold, ids play no part, and mail that arrives later is scored by the models
that did not see its content, in batch and stream alike.

Fitting is one count per (mark, fold) and one row of sums per fold; only rows per fold reach the driver. Weights and sums are kept
as integers, so results do not depend on the order of additions. A fitted model is a table of weights and one of
parameters; `save` adds a version to a folder, `load` reads the newest whole one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.functions.common import extract_all
from lurewatch.rules.feature_names import ATTACHMENT, HEADER, IDENTITY, PHONE, TEXT, URL
from lurewatch.rules.lexicons import BANK_NAMES
from lurewatch.session import cut_lineage

FOLDS, MIN_MESSAGES, Z = 5, 5, 3.0
KNOTS = 8  # knots at -KNOTS .. KNOTS of the blended score
SCALE, PLACE = 1_000_000, 1000  # weights in millionths, scores and knot shares in thousandths
STRUCTURE = (*HEADER, *URL, *PHONE, *IDENTITY, *TEXT, *ATTACHMENT, *(f"lex_{n}_count" for n in BANK_NAMES), *(f"lexsubj_{n}" for n in BANK_NAMES))
VECTORS = ("spam_unwanted", "advance_fee_fraud", "recon_probe", "credential_phishing", "malware_delivery")
SURE = 0.5  # weak labels of this confidence teach the vector classifier
PARAMETERS = "fold int, a double, b double, c double, knots array<double>"


def fold_of(subject: str = "subject", body: str = "body") -> Column:
    """The fold of a message's content."""
    digest = F.md5(F.concat(subject, F.lit("\n"), body))
    return F.pmod(F.conv(F.left(digest, F.lit(8)), 16, 10).cast("bigint"), F.lit(FOLDS)).cast("int")


def with_marks(features: DataFrame) -> DataFrame:
    """Add fold, words and shape (names of features above zero). Needs subject, body and the features."""
    text = F.lower(F.concat("subject", F.lit(" "), "body"))
    on = F.filter(F.array(*[F.when(F.col(n) > 0, F.lit(n)) for n in STRUCTURE]), lambda x: x.isNotNull())
    return features.withColumns({"fold": fold_of(), "words": F.array_distinct(extract_all(text, "[a-z]{3,}")), "shape": on})


def marks(rows: DataFrame, *keep: str) -> DataFrame:
    """(message_id, fold, view, mark, keep...), a row per mark of either view."""
    both = F.concat(F.transform("words", lambda m: F.struct(F.lit("wording").alias("view"), m.alias("mark"))),
                    F.transform("shape", lambda m: F.struct(F.lit("structure").alias("view"), m.alias("mark"))))
    return rows.select("message_id", "fold", *keep, F.explode(both).alias("m")).select("message_id", "fold", *keep, "m.view", "m.mark")


def _others(totals: list, cls: str) -> dict[int, tuple[int, int]]:
    """Messages in and not in a class outside of each fold."""
    inside, every = {}, {}
    for fold, c, n in totals:
        every[fold] = every.get(fold, 0) + n
        if c == cls:
            inside[fold] = inside.get(fold, 0) + n
    return {f: (sum(inside.values()) - inside.get(f, 0), sum(every.values()) - every.get(f, 0) - sum(inside.values()) + inside.get(f, 0)) for f in range(FOLDS)}


def fit_weights(found: DataFrame, totals: list, classes: list[str]) -> DataFrame:
    """(fold, view, mark, cls, weight): one against the rest, from the other folds. `found` has view, mark, fold, cls;
    totals are (fold, cls, messages)."""
    spark = found.sparkSession
    names = [f"c{i}" for i in range(len(classes))]
    per = found.groupBy("view", "mark", "fold").agg(*[F.count_if(F.col("cls") == c).alias(n) for n, c in zip(names, classes)])
    per = per.groupBy("view", "mark").agg(F.collect_list(F.struct("fold", *names)).alias("folds"), sum((F.sum(n) for n in names), F.lit(0)).alias("ever"))  # a row per fold at most
    per = per.where(F.col("ever") >= MIN_MESSAGES).drop("ever")
    n = spark.createDataFrame([(f, i, *_others(totals, c)[f]) for i, c in enumerate(classes) for f in range(FOLDS)], "own int, i int, n_in bigint, n_out bigint")

    def seen(names):
        return F.aggregate("folds", F.lit(0).cast("bigint"), lambda a, x: a + F.when(x.fold == F.col("own"), F.lit(0)).otherwise(sum((x[m] for m in names), F.lit(0))))

    df = per.crossJoin(F.broadcast(n))  # FOLDS x classes rows
    pick = F.lit(None).cast("bigint")
    for i in range(len(classes)):
        pick = F.when(F.col("i") == i, seen([f"c{i}"])).otherwise(pick)
    df = df.withColumns({"inside": pick, "all": seen([f"c{i}" for i in range(len(classes))])}).withColumn("outside", F.col("all") - F.col("inside"))
    w = F.log((F.col("inside") + 0.5) / (F.col("n_in") + 1.0)) - F.log((F.col("outside") + 0.5) / (F.col("n_out") + 1.0))
    n_in, n_out, held = (F.col(c).cast("double") for c in ("n_in", "n_out", "all"))
    apart, n = F.col("inside") * n_out - F.col("outside") * n_in, n_in + n_out
    sure = (apart != 0) & (apart * apart * n >= Z * Z * held * (n - held) * n_in * n_out)
    df = df.where(F.col("all") >= MIN_MESSAGES).where(sure).withColumn("w", w)
    name = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("i") + 1)
    return df.select(F.col("own").alias("fold"), "view", "mark", name.alias("cls"), F.round(F.col("w") * SCALE).cast("bigint").alias("weight"))


def sums(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(message_id, wording, structure) of every row, in millionths. Partial sums leave a task, not marks."""
    hit = marks(rows).join(weights.where("cls = '1'"), ["fold", "view", "mark"])
    got = hit.groupBy("message_id").agg(*[F.sum(F.when(F.col("view") == v, F.col("weight")).otherwise(0)).alias(v) for v in ("wording", "structure")])
    return rows.select("message_id", "fold").join(got, "message_id", "left").na.fill(0, ["wording", "structure"])


def _discriminant(one: list[int], zero: list[int]) -> tuple[float, float, float]:
    """(a, b, c) of a x + b y + c from n, sums and sums of products of either class, in thousandths."""
    if min(one[0], zero[0]) < 2:
        return 1.0, 1.0, 0.0
    mean = [[s[1] / s[0] / PLACE, s[2] / s[0] / PLACE] for s in (zero, one)]
    n = one[0] + zero[0] - 2

    def pooled(k, i, j):
        return sum(s[k] / PLACE / PLACE - s[0] * m[i] * m[j] for s, m in ((zero, mean[0]), (one, mean[1]))) / n

    xx, yy, xy = pooled(3, 0, 0) + 0.01, pooled(4, 1, 1) + 0.01, pooled(5, 0, 1)
    dx, dy, det = mean[1][0] - mean[0][0], mean[1][1] - mean[0][1], xx * yy - xy * xy
    a, b = (yy * dx - xy * dy) / det, (xx * dy - xy * dx) / det
    return a, b, math.log(one[0] / zero[0]) - 0.5 * (a * (mean[0][0] + mean[1][0]) + b * (mean[0][1] + mean[1][1]))


def _pick(values: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("fold") + 1)


def _blended(scores: DataFrame, abc: list[tuple]) -> DataFrame:
    """Add lo (the knot below) and share (of the knot above, in thousandths)."""
    a, b, c = (_pick([p[i] for p in abc]) for i in range(3))
    z = [F.round(F.col(v) / (SCALE // PLACE)) / PLACE for v in ("wording", "structure")]
    s = F.greatest(F.lit(-float(KNOTS)), F.least(F.lit(KNOTS - 0.001), a * z[0] + b * z[1] + c))
    df = scores.withColumn("s", F.round(s, 3))
    return df.withColumn("lo", F.floor("s").cast("int")).withColumn("share", F.round((F.col("s") - F.col("lo")) * PLACE).cast("bigint"))


class IntentModel:
    """Weights (fold, view, mark, cls, weight) and parameters per fold."""

    def __init__(self, weights: DataFrame, abc: list[tuple], knots: list[list[float]]) -> None:
        self.weights, self.abc, self.knots = weights, abc, knots

    def predict(self, rows: DataFrame) -> DataFrame:
        """(message_id, p) from rows with message_id, fold, words, shape; p is kept to six decimals."""
        df = _blended(sums(rows, self.weights), self.abc)
        table = F.array(*[F.array(*[F.lit(k) for k in fold]) for fold in self.knots])
        own = F.element_at(table, F.col("fold") + 1)
        lo, hi = (F.element_at(own, F.col("lo") + KNOTS + 1 + i) for i in (0, 1))
        share = F.col("share") / PLACE
        return df.select("message_id", F.round(lo * (1 - share) + hi * share, 6).alias("p"))

    def save(self, path: str, version: int) -> None:
        """Parameters go last: a version without them is not whole."""
        spark = self.weights.sparkSession
        self.weights.write.parquet(f"{path}/v={version}/weights")
        rows = [(f, *self.abc[f], self.knots[f]) for f in range(FOLDS)]
        spark.createDataFrame(rows, PARAMETERS).coalesce(1).write.parquet(f"{path}/v={version}/parameters")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> IntentModel:
        """A version, the newest whole one by default."""
        if version is None:
            version = max(_versions(spark, path), default=None)
            if version is None:
                raise FileNotFoundError(f"no whole model in {path}")
        rows = sorted(map(tuple, spark.read.schema(PARAMETERS).parquet(f"{path}/v={version}/parameters").collect()))  # a row per fold
        return IntentModel(spark.read.parquet(f"{path}/v={version}/weights"), [r[1:4] for r in rows], [list(r[4]) for r in rows])


def _versions(spark: SparkSession, path: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    if not fs.exists(root):
        return []
    names = [f.getPath() for f in fs.listStatus(root)]
    whole = spark._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
    return [int(p.getName()[2:]) for p in names if p.getName()[2:].isdigit() and fs.exists(whole(p, "parameters/_SUCCESS"))]


def fit_intent(rows: DataFrame) -> IntentModel:
    """Fit on rows with message_id, label (0 or 1), fold, words and shape."""
    rows = rows.withColumn("cls", F.col("label").cast("string"))
    totals = [tuple(r) for r in rows.groupBy("fold", "cls").count().collect()]  # two rows a fold
    weights = cut_lineage(fit_weights(marks(rows, "cls"), totals, ["0", "1"]).where("cls = '1'"))
    scores = cut_lineage(sums(rows, weights).join(rows.select("message_id", "label"), "message_id"))
    x, y = (F.round(F.col(v) / (SCALE // PLACE)).cast("decimal(19,0)") for v in ("wording", "structure"))
    made = scores.select("fold", "label", x.alias("x"), y.alias("y")).groupBy("fold", "label").agg(
        F.count("*"), F.sum("x"), F.sum("y"), *[F.sum(p) for p in (F.col("x") * F.col("x"), F.col("y") * F.col("y"), F.col("x") * F.col("y"))]).collect()  # two rows a fold

    def outside(fold, label):
        return [sum(int(r[i]) for r in made if r[0] != fold and r[1] == label) for i in range(2, 8)]

    abc = [_discriminant(outside(f, 1), outside(f, 0)) for f in range(FOLDS)]
    placed = _blended(scores, abc)
    ends = F.explode(F.array(F.struct(F.col("lo").alias("k"), (PLACE - F.col("share")).alias("n")), F.struct((F.col("lo") + 1).alias("k"), F.col("share").alias("n"))))
    rates = placed.select("fold", "label", ends.alias("e")).groupBy("fold", "e.k").agg(F.sum("e.n").alias("n"), F.sum(F.col("e.n") * F.col("label")).alias("hits")).collect()  # knots x folds
    knots = []
    for f in range(FOLDS):
        row, top = [], 0.0
        for k in range(-KNOTS, KNOTS + 1):
            n, hits = (sum(r[i] for r in rates if r[0] != f and r[1] == k) for i in (2, 3))
            top = max(top, (hits + 0.5 * PLACE) / (n + PLACE)) if n else top
            row.append(top)
        knots.append(row)
    return IntentModel(weights, abc, knots)


def fit_vectors(rows: DataFrame) -> tuple[DataFrame, list[tuple[int, str, int]]]:
    """Weights of the vector classifier and its totals, from malicious rows with a sure weak label (rule_vector, rule_confidence)."""
    sure = rows.where((F.col("label") == 1) & (F.col("rule_confidence") >= SURE) & F.col("rule_vector").isin(*VECTORS)).withColumn("cls", F.col("rule_vector"))
    totals = [tuple(r) for r in sure.groupBy("fold", "cls").count().collect()]  # a row per fold and vector
    return cut_lineage(fit_weights(marks(sure, "cls"), totals, list(VECTORS))), totals


def predict_vectors(rows: DataFrame, weights: DataFrame, totals: list) -> DataFrame:
    """(message_id, clf_vector, clf_p): the best vector, and its share of the evidence. Evidence of n marks counts as much as root n,
    as marks of one message are not independent."""
    spark = rows.sparkSession
    prior = [(f, i, c, round(SCALE * math.log((_others(totals, c)[f][0] + 1.0) / (_others(totals, c)[f][1] + 1.0)))) for i, c in enumerate(VECTORS) for f in range(FOLDS)]
    hit = marks(rows).join(weights, ["fold", "view", "mark"]).groupBy("message_id", "cls").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    start = spark.createDataFrame(prior, "fold int, i int, cls string, prior bigint")
    df = rows.select("message_id", "fold").join(F.broadcast(start), "fold").join(hit, ["message_id", "cls"], "left")
    z = F.round((F.col("prior") + F.coalesce("w", F.lit(0))) / SCALE / F.sqrt(F.greatest(F.lit(1), F.coalesce("n", F.lit(0)))), 6)
    df = df.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct((-z).alias("neg"), "i", "cls"))).alias("v"))  # a row per vector
    top = F.col("v")[0]
    return df.select("message_id", top.cls.alias("clf_vector"), F.round(1.0 / F.aggregate("v", F.lit(0.0), lambda a, x: a + F.exp(top.neg - x.neg)), 6).alias("clf_p"))
