"""Evaluation of scored tables. Rows are counted per distinct score before anything is
ordered, so heavy ties shrink instead of piling up."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerflow.functions.expr import funnel_probability
from offerflow.operators.ordered import running
from offerflow.session import few_rows


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC with ties counted half, per group; null where a group lacks a class."""
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) > 0, 0).otherwise(1)).alias("neg"))
    cum = running(counts, [score], by, sums=["neg"])
    wins = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)
    total = F.sum("pos").cast("double") * F.sum("neg")
    return cum.groupBy(*by).agg(F.try_divide(F.sum(wins), total).alias("auc"))


def masked_auc(df: DataFrame, tasks: Sequence[tuple[str, str]], ignore: int = -100) -> DataFrame:
    """AUC per (label, score) task, leaving out rows labelled ``ignore``."""
    rows = F.array(*[F.struct(F.lit(label).alias("task"), F.col(label).cast("double").alias("label"),
                              F.col(score).cast("double").alias("score"))
                     for label, score in tasks])
    long = df.select(F.inline(rows)).where(F.col("label") != ignore)
    return auc(long, "label", "score", ["task"])


def recall_at(df: DataFrame, label: str, score: str, p: float, keys: Sequence[str],
              by: Sequence[str] = ()) -> DataFrame:
    """Share of the positives among the best int(n * p) + 1 rows of each group."""
    ranked = running(df.select(*by, *keys, label, score), [f"-{score}", *keys], by)
    # group sizes come from the staged ranks, not from the input again
    n = ranked.groupBy(*[F.col(b).alias(f"_b_{b}") for b in by]).agg(F.max("rn").alias("_n"))
    if by:
        on = [F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in by]
        ranked = ranked.join(few_rows(n), on)
    else:
        ranked = ranked.withColumn("_n", F.lit(n.first()["_n"] or 0))
    # the first row has position 0, so the slice 0 .. int(n * p) holds one row more
    inside = F.col("rn") <= F.floor(F.col("_n") * F.lit(float(p))) + 1
    hit = F.sum(F.when(inside & (F.col(label) > 0), 1).otherwise(0))
    return ranked.groupBy(*by).agg(
        F.try_divide(hit, F.sum(F.when(F.col(label) > 0, 1).otherwise(0))).alias("recall"))


def thresholds(bottom: float = 0.0, top: float = 1.0, step: float = 0.01, dec: int = 2) -> list[float]:
    n = int(round((top - bottom) / step)) + 1
    return [t for t in (round(bottom + i * step, dec) for i in range(n)) if t <= top]


def threshold_table(df: DataFrame, label: str, score: str, cuts: Sequence[float],
                    all_positives: int | None = None) -> DataFrame:
    """precision, recall, count, recall of an outside total, and F1 per threshold.

    Each row is put under its highest threshold once, by binary search, whatever the
    thresholds' distances; the rest works on one row per threshold."""
    cuts = sorted({float(c) for c in cuts})
    table = F.array(*[F.lit(c) for c in cuts])
    placed = df.where(F.col(score).isNotNull()).withColumn("_at", F.lit(-1))
    step = 1 << (len(cuts).bit_length() - 1 if cuts else 0)
    while step:
        placed = placed.withColumn("_at", F.when(
            F.get(table, F.col("_at") + step) <= F.col(score), F.col("_at") + step).otherwise(F.col("_at")))
        step >>= 1
    counts = placed.groupBy("_at").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("_p"))
    # position -1 holds the rows below every threshold; they count as positives missed
    spot = F.col("id").cast("int")
    grid = df.sparkSession.range(-1, len(cuts)).select(
        spot.alias("_at"), F.when(spot >= 0, F.get(table, spot)).alias("threshold"))
    full = grid.join(counts, "_at", "left").fillna(0, ["_n", "_p"])
    above = Window.orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(0))
    cum = full.select("threshold", F.sum("_n").over(above).alias("count"),
                      F.sum("_p").over(above).alias("hits"),
                      F.sum("_p").over(every).alias("positives")).where("threshold is not null")
    zero = F.lit(0.0)
    out = cum.select(
        "threshold",
        F.coalesce(F.try_divide("hits", "count"), zero).alias("precision"),
        F.coalesce(F.try_divide("hits", "positives"), zero).alias("recall"), "count",
        (F.col("hits") / F.lit(all_positives) if all_positives
         else F.coalesce(F.try_divide("hits", "positives"), zero)).alias("recall_all"))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall_all"),
                      F.col("precision") + F.col("recall_all"))
    return out.withColumn("f1_all", f1)


def topk_recall(df: DataFrame, rank: str, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose true item ranks below k."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.when(F.col(rank) < k, 1.0).otherwise(0.0)).alias(f"recall_top_{k}") for k in ks])


def bce(p: Column, y: Column) -> Column:
    """Binary cross-entropy of one row; logarithms are floored at -100."""
    log = lambda x: F.greatest(F.when(x > 0, F.ln(x)).otherwise(F.lit(-100.0)), F.lit(-100.0))
    return -(y * log(p) + (F.lit(1.0) - y) * log(F.lit(1.0) - p))


def logloss(df: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    """Mean cross-entropy; weights multiply the rows, the mean stays over the row count."""
    loss = bce(F.col(score), F.col(label))
    return df.agg(F.avg(loss * F.col(weight) if weight else loss).alias("logloss"))


def focal_loss(df: DataFrame, label: str, score: str, alpha: float = 1.0,
               gamma: float = 2.0) -> DataFrame:
    loss = bce(F.col(score), F.col(label))
    pt = F.exp(-loss)
    return df.agg(F.avg(F.lit(alpha) * F.pow(F.lit(1.0) - pt, F.lit(gamma)) * loss).alias("focal_loss"))


def ips_loss(df: DataFrame, labels: Sequence[str], scores: Sequence[str],
             ips_weight: float = 0.1, task_weight: float = 1.0) -> DataFrame:
    """Funnel loss: cross-entropy of the running product for every step, plus each later
    step's cross-entropy where the previous label is set, divided by the previous step's
    probability (inverse clamped to 1e3)."""
    total = F.lit(0.0)
    for label, p in zip(labels, funnel_probability(list(scores))):
        total = total + F.avg(bce(p, F.col(label))) * task_weight
    for i in range(1, len(scores)):
        inverse = F.greatest(F.lit(-1e3), F.least(F.lit(1e3), F.coalesce(
            F.try_divide(F.lit(1.0), F.col(scores[i - 1])), F.lit(1e3))))
        step = bce(F.col(scores[i]), F.col(labels[i])) * F.col(labels[i - 1]) * inverse
        total = total + F.avg(step) * ips_weight
    return df.agg(total.alias("ips_loss"))


def model_areas(df: DataFrame, label: str, raw: str = "rawPrediction") -> dict[str, float]:
    """Areas under the ROC and precision-recall curves of a Spark model's output."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    return {name: BinaryClassificationEvaluator(
        labelCol=label, rawPredictionCol=raw, metricName=metric, numBins=0).evaluate(df)
        for name, metric in (("roc_auc", "areaUnderROC"), ("pr_auc", "areaUnderPR"))}


def cv_auc(folds: DataFrame, label: str, k: int, fit_score: Callable[[DataFrame, DataFrame], DataFrame],
           fold: str = "fold") -> DataFrame:
    """Mean AUC over the folds. ``fit_score(train, test)`` returns test with ``score``."""
    scored = None
    for i in range(k):
        part = fit_score(folds.where(F.col(fold) != i), folds.where(F.col(fold) == i))
        part = part.select(F.lit(i).alias("fold"), label, "score")
        scored = part if scored is None else scored.unionByName(part)
    return auc(scored, label, "score", ["fold"]).agg(F.avg("auc").alias("cv_auc"),
                                                     F.count(F.lit(1)).alias("folds"))
