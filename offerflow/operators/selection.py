"""Feature importance from fitted Spark models and from shuffled columns."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerflow.functions.expr import hash_order
from offerflow.operators.evaluate import auc
from offerflow.operators.ordered import quantiles_of_counts, running, values_at_ranks
from offerflow.session import stage

#: Bins per feature where the trees' parameters state none, and cells of one task of a fit.
MAX_BINS = 32
CELLS_PER_TASK = 50_000


def shuffle_columns(df: DataFrame, keys: Sequence[str], cols: Sequence[str], seed: int | str,
                    suffix: str = "_shuffled") -> DataFrame:
    """Adds a random permutation of ``cols`` (one and the same for all of them): the rows
    are numbered in two hash orders and joined on the number."""
    left = running(df.withColumn("_h", hash_order(list(keys), f"{seed}a")), ["_h", *keys], rank="_pos", uniform="_h").drop("_h")
    right = df.select(hash_order(list(keys), f"{seed}b").alias("_h"), *[F.col(k).alias(f"_k_{k}") for k in keys],
                      *[F.col(c).alias(c + suffix) for c in cols])
    right = running(right, ["_h", *[f"_k_{k}" for k in keys]], rank="_pos", uniform="_h").drop(
        "_h", *[f"_k_{k}" for k in keys])
    return left.join(right, "_pos").drop("_pos")


def permutation_importance(df: DataFrame, keys: Sequence[str], cols: Sequence[str], label: str,
                           score: Callable[[DataFrame], DataFrame], seed: int = 1,
                           repeats: int = 1) -> DataFrame:
    """AUC lost when one feature is shuffled, averaged over ``repeats`` permutations.

    ``score(df)`` adds a ``score`` column. All variants are scored and evaluated in one
    plan, keyed by the shuffled feature."""
    base = stage(score(df.select(*keys, label, *cols)).select(label, "score"), "base")
    scored = base.select(F.lit("").alias("feature"), F.lit(0).alias("rep"), label, "score")
    for r in range(repeats):
        mixed = stage(shuffle_columns(df.select(*keys, label, *cols), keys, cols, f"{seed}-{r}"), "mixed")
        for c in cols:
            swapped = mixed.withColumn(c, F.col(f"{c}_shuffled")).select(*keys, label, *cols)
            scored = scored.unionByName(score(swapped).select(
                F.lit(c).alias("feature"), F.lit(r).alias("rep"), label, "score"))
    areas = auc(scored, label, "score", ["feature", "rep"])
    whole = areas.where("feature = ''").first()["auc"]
    return (areas.where("feature <> ''").groupBy("feature")
            .agg((F.lit(whole) - F.avg("auc")).alias("importance"))
            .orderBy(F.col("importance").desc(), "feature"))


def feature_importance(spark, weights: Mapping[str, float], names: Sequence[str]) -> DataFrame:
    """Importances by name, 0 where the model does not use the feature, largest first."""
    rows = sorted(((n, float(weights.get(n, 0.0))) for n in names), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def _present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The features as doubles, missing ones as 0."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})


def binner(df: DataFrame, cols: Sequence[str], bins: int) -> PipelineModel:
    """Adds ``_bin_c`` per feature c, the number of its bin. There are at most ``bins``: one per value where it
    has no more values, else between quantiles of all rows (rank error 1 / 10,000). Two scans of the columns."""
    data = _present(df.select(*cols), cols)
    probs = [i / bins for i in range(1, bins)]
    row = data.agg(*[f(c).alias(f"{name}{i}") for i, c in enumerate(cols) for name, f in (
        ("q", lambda c: F.percentile_approx(c, probs, F.lit(10_000))), ("n", F.approx_count_distinct))]).first()
    # the number is an estimate, so it is known before the values are fetched that they are few
    few = [c for i, c in enumerate(cols) if row[f"n{i}"] <= 2 * bins]
    seen = data.agg(*[F.collect_set(c).alias(c) for c in few]).first().asDict() if few else {}
    edges = []
    for i, c in enumerate(cols):
        values = sorted(set(seen.get(c, ())))
        cuts = (values[1:] or values) if c in seen and len(values) <= bins else sorted(set(row[f"q{i}"] or ()))
        edges.append([-math.inf, *([x for x in cuts if math.isfinite(x)] or [0.0]), math.inf])
    cut = Bucketizer(splitsArray=edges, inputCols=list(cols), outputCols=[f"_cut_{c}" for c in cols])
    # the bucketizer marks its numbers as categories; in a sum they are ordered numbers again
    numbers = SQLTransformer(statement="SELECT *, " + ", ".join(f"`_cut_{c}` + 0.0D AS `_bin_{c}`" for c in cols) + " FROM __THIS__")
    return PipelineModel([cut, numbers])


def _bins(cols: Sequence[str]) -> list[str]:
    return [f"_bin_{c}" for c in cols]


def _fit(cells: DataFrame, bins: PipelineModel, cols: Sequence[str], label: str, weight: str, **params) -> PipelineModel:
    """Trees on cells of equal bins and label, each as heavy as its rows; at most about
    ``CELLS_PER_TASK`` of them in a partition of what the trees keep in memory."""
    names = _bins(cols)
    some = cells.where(F.col(weight) > 0)
    spread = some.repartition(max(1, -(-some.count() // CELLS_PER_TASK)), label, *names)
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    trees = GBTClassifier(featuresCol="features", labelCol=label, weightCol=weight, **params).fit(assembler.transform(spread))
    return PipelineModel([bins, assembler, trees])


def boosted_trees(df: DataFrame, cols: Sequence[str], label: str, **params) -> PipelineModel:
    """Binned and assembled features (missing counts as 0) and gradient-boosted trees.

    The trees look at a feature through ``maxBins`` bins only. So the rows are binned first and counted
    per (bins, label): the weighted cells give the trees of all rows, while what every iteration
    reads and keeps in memory no longer grows with the rows where features have few bins or columns are few."""
    bins = binner(df, cols, params.get("maxBins", MAX_BINS))
    rows = bins.transform(_present(df.select(label, *cols), cols))
    cells = stage(rows.groupBy(label, *_bins(cols)).agg(F.count(F.lit(1)).cast("double").alias("_weight")), "cells")
    return _fit(cells, bins, cols, label, "_weight", **params)


def model_importance(spark, model: PipelineModel, cols: Sequence[str]) -> DataFrame:
    weights = model.stages[-1].featureImportances
    return feature_importance(spark, {c: weights[i] for i, c in enumerate(cols)}, cols)


def null_score(actual: DataFrame, null: DataFrame) -> DataFrame:
    """ln(1e-10 + actual / (1 + 75 % point of the null importances)) per feature."""
    counts = null.groupBy("feature", F.col("importance").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    q = quantiles_of_counts(counts, [0.75], ["feature"]).select("feature", "q0")
    return actual.join(q, "feature").select("feature", F.ln(
        F.lit(1e-10) + F.col("importance") / (F.lit(1.0) + F.col("q0"))).alias("gain_score"))


def null_importance(df: DataFrame, keys: Sequence[str], cols: Sequence[str], label: str, k: int = 10,
                    seed: int = 1, **params) -> DataFrame:
    """Tree importances against those of k fits on truly shuffled labels.

    A shuffle puts all rows in a random order, by a hash of their keys, and deals the labels out along
    it, as many of each as there are. Where one label's stretch ends is an exact order statistic of the
    hash, so all k shuffles are counted per cell of equal bins in one aggregate: no row is moved for them."""
    spark = df.sparkSession
    data = df.select(*cols, label, *[(F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}-{i}"), *keys), 12)).alias(f"_h{i}")
                                     for i in range(k)])
    bins = binner(df, cols, params.get("maxBins", MAX_BINS))
    rows = stage(bins.transform(_present(data, cols)).select(label, *_bins(cols), *[f"_h{i}" for i in range(k)]), "null")
    sizes = [(r[0], r["n"]) for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label).collect()]
    ends = list(itertools.accumulate(n for _, n in sizes))
    _, last = values_at_ranks(rows, [f"_h{i}" for i in range(k)], lambda n: {e - 1 for e in ends})
    counts = [F.count_if(F.col(label).eqNullSafe(F.lit(v))).alias(f"_a_{j}") for j, (v, _) in enumerate(sizes)]
    for i in range(k):
        below = F.lit(False)
        for j, end in enumerate(ends):
            upto = F.col(f"_h{i}") <= F.lit(int(last[f"_h{i}"][end - 1]))
            counts.append(F.count_if(upto & ~below).alias(f"_{i}_{j}"))
            below = upto
    cells = stage(rows.groupBy(*_bins(cols)).agg(*counts), "cells")

    def fit(run: int | str) -> DataFrame:
        labelled = F.inline(F.array(*[F.struct(F.lit(v).alias(label), F.col(f"_{run}_{j}").cast("double").alias("_weight"))
                                      for j, (v, _) in enumerate(sizes)]))
        model = _fit(cells.select(*_bins(cols), labelled), bins, cols, label, "_weight", **params)
        return model_importance(spark, model, cols)

    return null_score(fit("a"), functools.reduce(DataFrame.unionByName, [fit(i) for i in range(k)]))
