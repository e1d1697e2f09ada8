"""Correlations and feature tests from one-pass moments.

Moments are taken as means and (co)variances, which Spark merges stably, not as raw sums
of squares."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerflow.functions.pvalue import chi2_pvalue, f_pvalue
from offerflow.operators.ordered import average_ranks, running
from offerflow.operators.profile import long_summary
from offerflow.session import shuffle_width, stage


#: Values of a feature held by more than this part of the rows are few enough to broadcast.
FREQUENT = 1000
#: Ranks of one partition that puts them back into rows.
PART_ROWS = 2_000_000


def _pairs_frame(df: DataFrame, rows: Sequence[tuple[str, str, Column]]) -> DataFrame:
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"),
                 F.coalesce(F.nanvl(c, F.lit(None)), F.lit(0.0)).alias("corr"))
        for a, b, c in rows])))


def pearson(x: Column, y: Column) -> Column:
    """Correlation aggregate over rows that hold both; null where one side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def corr_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson",
                weight: str | None = None) -> DataFrame:
    """Correlation of every column pair (x before y) over rows that hold both; undefined
    ones are 0. Methods: pearson, spearman, kendall, each also weighted."""
    pairs = list(combinations(cols, 2))
    if method == "pearson" and weight is None:
        names = {p: f"_{i}" for i, p in enumerate(pairs)}
        aggs = [pearson(F.col(a), F.col(b)).alias(names[a, b]) for a, b in pairs]
        return _pairs_frame(df.agg(*aggs), [(a, b, F.col(names[a, b])) for a, b in pairs])
    if method == "pearson":
        return weighted_pearson(df, pairs, weight)
    one = {"spearman": spearman, "kendall": kendall}.get(method)
    if one is None:
        raise ValueError(f"unknown method {method!r}")
    order = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "_pair int, x string, y string")
    out = one(df, pairs, weight).withColumnRenamed("pair", "_pair")
    return order.join(F.broadcast(out), "_pair", "left").select(
        "x", "y", F.coalesce(F.nanvl("corr", F.lit(None)), F.lit(0.0)).alias("corr"))


def weighted_pearson(df: DataFrame, pairs: Sequence[tuple[str, str]], weight: str) -> DataFrame:
    """Five weighted sums per pair, around the plain means to keep digits."""
    cols = sorted({c for p in pairs for c in p})
    centre = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    w = F.col(weight).cast("double")
    aggs, rows = [], []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = (F.col(c) - F.lit(float(centre[c] or 0.0)) for c in (a, b))
        for name, v in (("w", w), ("x", w * x), ("y", w * y), ("xx", w * x * x),
                        ("yy", w * y * y), ("xy", w * x * y)):
            aggs.append(F.sum(F.when(both, v)).alias(f"{name}_{i}"))
        s = lambda n, i=i: F.try_divide(F.col(f"{n}_{i}"), F.col(f"w_{i}"))
        var = (s("xx") - s("x") * s("x")) * (s("yy") - s("y") * s("y"))
        rows.append((a, b, F.try_divide(s("xy") - s("x") * s("y"), F.sqrt(var))))
    return _pairs_frame(df.agg(*aggs), rows)


def _rank_features(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> tuple[list[tuple[str, str | None]], list[tuple[int, int]]]:
    """(features, per pair the two it takes). A feature is a column, or a column among the rows that hold another one:
    a partner with nulls needs ranks of its own."""
    cols = sorted({c for p in pairs for c in p})
    holes = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    features: dict[tuple[str, str | None], int] = {}

    def place(c: str, partner: str) -> int:
        return features.setdefault((c, partner if holes[partner] else None), len(features))

    taken = [(place(a, b), place(b, a)) for a, b in pairs]
    return list(features), taken


def _ranked(long: DataFrame, ranks: DataFrame, many: int) -> DataFrame:
    """The long rows with the rank of their value. All rows of one value would meet in one task of a join, so the
    values of more than ``many`` rows, fewer than ``FREQUENT`` a feature, are broadcast; the others are joined by a shuffle."""
    frequent = F.broadcast(ranks.where(F.col("n") > many).select("f", "v", F.col("avg_rank").alias("_often")))
    marked = long.join(frequent, ["f", "v"], "left")
    rare = marked.where(F.col("_often").isNull()).drop("_often").join(
        ranks.where(F.col("n") <= many).select("f", "v", "avg_rank").hint("merge"), ["f", "v"])
    return marked.where(F.col("_often").isNotNull()).withColumnRenamed("_often", "avg_rank").unionByName(rare)


def spearman(df: DataFrame, pairs: Sequence[tuple[str, str]], weight: str | None = None) -> DataFrame:
    """(pair, corr) by number of the pair, over the rows that hold both columns: the Pearson correlation of the average
    ranks or, with a weight, 1 - 6 sum(w d^2) / (N (N^2 - 1)) with N = sum(w) and unweighted average
    ranks (not a true weighted rank correlation; kept because results are compared with it).

    One plan for any number of columns, with or without nulls: all features are unpivoted once and ranked by
    one ordered pass, their ranks come back to the rows, and the sums of all pairs are matrix
    products of Arrow batches."""
    features, taken = _rank_features(df, pairs)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cols = sorted({c for p in pairs for c in p})
    data = stage(df.select(F.monotonically_increasing_id().alias("_id"), w.alias("_w"),
                           *[F.col(c).cast("double").alias(c) for c in cols]), "ranks")
    values = F.array(*[F.struct(F.lit(i).alias("f"), (F.col(c) if other is None else F.when(F.col(other).isNotNull(), F.col(c))).alias("v"))
                       for i, (c, other) in enumerate(features)])
    long = data.select("_id", "_w", F.inline(values)).where(F.col("v").isNotNull())
    counts = long.groupBy("f", "v").agg(F.count(F.lit(1)).alias("n"))
    ranks = average_ranks(counts, "v", by=["f"])
    every = len(features)
    total_rows = data.count()
    ranked = _ranked(long, stage(ranks, "values"), max(1, total_rows // FREQUENT))
    # placed by row before they are grouped, so that no task holds more rows than its partition has
    placed = ranked.repartition(max(shuffle_width(df), -(-total_rows * every // PART_ROWS)), "_id")
    wide = placed.groupBy("_id").agg(
        F.first("_w").alias("_w"), *[F.max(F.when(F.col("f") == i, F.col("avg_rank"))).alias(f"r{i}") for i in range(every)])
    middle = (total_rows + 1) / 2.0
    names = ["pair", "n", "sx", "sy", "sxx", "syy", "sxy"]

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, every, every))
        for batch in batches:
            w = batch.column(0).to_numpy(zero_copy_only=False)
            r = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(every)], axis=1) - middle
            there = ~np.isnan(r)
            r, there = np.where(there, r, 0.0), there.astype(float)
            mine = there * w[:, None]
            weighted = r * w[:, None]
            sums += np.stack([mine.T @ there, weighted.T @ there, (weighted * r).T @ there, weighted.T @ r])
        x, y = np.array([t[0] for t in taken]), np.array([t[1] for t in taken])
        out = [np.arange(len(taken)), sums[0][x, y], sums[1][x, y], sums[1][y, x], sums[2][x, y], sums[2][y, x], sums[3][x, y]]
        yield pa.RecordBatch.from_arrays([pa.array(o) for o in out], names=names)

    parts = wide.select("_w", *[f"r{i}" for i in range(every)]).mapInArrow(
        gram, "pair long, " + ", ".join(f"{c} double" for c in names[1:]))
    total = parts.groupBy("pair").agg(*[F.sum(c).alias(c) for c in names[1:]])
    n = F.col("n")
    if weight:
        apart = F.col("sxx") - 2 * F.col("sxy") + F.col("syy")
        corr = F.lit(1.0) - F.try_divide(6 * apart, n * (n * n - 1))
    else:
        def spread(square: str, plain: str) -> Column:
            return F.col(square) - F.try_divide(F.col(plain) * F.col(plain), n)

        over = F.sqrt(spread("sxx", "sx")) * F.sqrt(spread("syy", "sy"))
        corr = F.try_divide(F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n), over)
    return total.select(F.col("pair").cast("int").alias("pair"), corr.alias("corr"))


def kendall(df: DataFrame, pairs: Sequence[tuple[str, str]], weight: str | None = None) -> DataFrame:
    """(pair, corr): tau-b over pairs of rows, a pair of rows weighing w_i * w_j, without forming them.

    Tied pairs come from group totals. Concordant pairs are counted bit by bit over the
    dense rank of y: two points with different y first differ at exactly one bit, so at
    each bit level the points that share the higher bits are walked in x order, every
    point with bit 1 adding its weight times the weight of the earlier points with bit 0.
    That is n log n rows through running sums. All column pairs go through one plan, keyed by their number.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    both = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
                     for i, (a, b) in enumerate(pairs)])
    long = df.select(w.alias("w"), F.inline(both)).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    cells = stage(long.groupBy("pair", "x", "y").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("ww")), "cells")
    dense = running(cells.select("pair", "y").distinct(), ["y"], ["pair"], rank="ry")
    points = stage(cells.join(dense, ["pair", "y"]).select("pair", "x", (F.col("ry") - 1).alias("ry"), "w"), "points")
    bits = max(int(points.agg(F.max("ry")).first()[0] or 0).bit_length(), 1)
    levels = (points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
              .withColumn("prefix", F.expr("shiftright(ry, level + 1)"))
              .withColumn("bit", F.expr("shiftright(ry, level) & 1")))
    steps = levels.groupBy("pair", "level", "prefix", "x").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("w")).otherwise(0.0)).alias("w0"),
        F.sum(F.when(F.col("bit") == 1, F.col("w")).otherwise(0.0)).alias("w1"))
    walked = running(steps, ["x"], ["pair", "level", "prefix"], sums=["w0"])
    out = walked.groupBy("pair").agg(F.sum(F.col("w1") * (F.col("cum_w0") - F.col("w0"))).alias("p"))

    def tied(name: str, *keys: str) -> DataFrame:
        sums = cells.groupBy("pair", *keys).agg(F.sum("w").alias("s"), F.sum("ww").alias("q"))
        return sums.groupBy("pair").agg((F.sum(F.col("s") * F.col("s") - F.col("q")) / 2).alias(name))

    for part in (tied("every"), tied("tx", "x"), tied("ty", "y"), tied("both", "x", "y")):
        out = out.join(F.broadcast(part), "pair")  # one row per pair of columns
    ordered = F.col("every") - F.col("tx") - F.col("ty") + F.col("both")  # concordant + discordant
    scale = F.sqrt((ordered + F.col("tx") - F.col("both")) * (ordered + F.col("ty") - F.col("both")))
    return out.select("pair", F.try_divide(2 * F.col("p") - ordered, scale).alias("corr"))


def _flag(scores: DataFrame, k: int, p_threshold: float) -> DataFrame:
    """Top-k and significance flags on the result table (one row per feature)."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc_nulls_last(), "feature")
    return (scores.withColumn("is_selected_score", (F.row_number().over(order) <= k).cast("int"))
            .withColumn("is_selected_p", F.coalesce((F.col("p_value") <= p_threshold).cast("int"),
                                                    F.lit(0)))
            .orderBy(F.col("score").desc_nulls_last(), F.col("p_value").desc(), "feature"))


def anova_scores(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """One-way F of every feature over the label classes, with its degrees of freedom."""
    per = long_summary(df, cols, {
        "n": lambda c: F.count(c), "mean": lambda c: F.avg(c), "var": lambda c: F.var_pop(c)},
        [label]).where("n > 0")
    whole = Window.partitionBy("feature")
    grand = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    per = per.withColumn("gap", F.col("mean") - grand)
    sums = per.groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("gap") * F.col("gap")).alias("ssb"),
        F.sum(F.col("n") * F.col("var")).alias("ssw"))
    return sums.select("feature", F.try_divide(
        F.try_divide("ssb", F.col("k") - 1), F.try_divide("ssw", F.col("n") - F.col("k"))).alias("score"),
        (F.col("k") - 1).alias("d1"), (F.col("n") - F.col("k")).alias("d2"))


def anova_f(df: DataFrame, cols: Sequence[str], label: str, k: int = 1,
            p_threshold: float = 0.05) -> DataFrame:
    out = anova_scores(df, cols, label).select(
        "feature", "score", f_pvalue(F.col("score"), F.col("d1"), F.col("d2")).alias("p_value"))
    return _flag(out, k, p_threshold)


def regression_scores(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """F of a simple regression on each feature, from its correlation with the target."""
    y = F.col(target).cast("double")
    per = long_summary(df, cols, {
        "r": lambda c: pearson(c, y),
        "n": lambda c: F.count(F.when(c.isNotNull() & y.isNotNull(), 1))})
    r2 = F.col("r") * F.col("r")
    return per.select("feature", F.try_divide(r2 * (F.col("n") - 2), 1 - r2).alias("score"),
                      F.lit(1).alias("d1"), (F.col("n") - 2).alias("d2"))


def f_regression(df: DataFrame, cols: Sequence[str], target: str, k: int = 1,
                 p_threshold: float = 0.05) -> DataFrame:
    out = regression_scores(df, cols, target).select(
        "feature", "score", f_pvalue(F.col("score"), F.col("d1"), F.col("d2")).alias("p_value"))
    return _flag(out, k, p_threshold)


def chi2_scores(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Class sums of non-negative features against the class shares."""
    per = long_summary(df, cols, {"seen": lambda c: F.sum(c.cast("double")),
                                  "n": lambda c: F.count(F.lit(1))}, [label])
    whole = Window.partitionBy("feature")
    expected = F.sum("seen").over(whole) * F.col("n") / F.sum("n").over(whole)
    per = per.withColumn("expected", expected)
    gap = F.col("seen") - F.col("expected")
    return per.groupBy("feature").agg(
        F.sum(F.try_divide(gap * gap, F.col("expected"))).alias("score"),
        (F.count(F.lit(1)) - 1).alias("dof"))


def chi2(df: DataFrame, cols: Sequence[str], label: str, k: int = 1,
         p_threshold: float = 0.05) -> DataFrame:
    out = chi2_scores(df, cols, label).select(
        "feature", "score", chi2_pvalue(F.col("score"), F.col("dof")).alias("p_value"))
    return _flag(out, k, p_threshold)


def _within(df: DataFrame, cols: Sequence[str], y: Column, by: Sequence[str]) -> DataFrame:
    """Per group and feature: rows and centred sums sxx, sxy, syy."""
    both = lambda c: c.isNotNull() & y.isNotNull()
    rows = long_summary(df, cols, {
        "n": lambda c: F.count(F.when(both(c), 1)),
        "vx": lambda c: F.var_pop(F.when(both(c), c.cast("double"))),
        "vy": lambda c: F.var_pop(F.when(both(c), y)),
        "cxy": lambda c: F.covar_pop(c.cast("double"), y)}, by).where("n > 0")
    return rows.select(*by, "feature", "n", (F.col("n") * F.col("vx")).alias("sxx"),
                       (F.col("n") * F.col("cxy")).alias("sxy"), (F.col("n") * F.col("vy")).alias("syy"))


def conditional_scores(df: DataFrame, cols: Sequence[str], label: str, item: str) -> DataFrame:
    """F of a feature in a regression that already holds the item dummies: both sides are
    centred within the item (Frisch-Waugh), which leaves a simple regression."""
    sums = _within(df, cols, F.col(label).cast("double"), [item]).groupBy("feature").agg(
        F.count(F.lit(1)).alias("items"), *[F.sum(c).alias(c) for c in ("n", "sxx", "sxy", "syy")])
    d2 = F.col("n") - F.col("items") - 1
    explained = F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    return sums.select("feature", F.try_divide(explained * d2, F.col("syy") - explained).alias("score"),
                       F.lit(1).alias("d1"), d2.alias("d2"))


def conditional_f(df: DataFrame, cols: Sequence[str], label: str, item: str) -> DataFrame:
    return conditional_scores(df, cols, label, item).select(
        "feature", "score", f_pvalue(F.col("score"), F.col("d1"), F.col("d2")).alias("p_value"))


def uplift_scores(df: DataFrame, cols: Sequence[str], arm: str, control, label: str) -> DataFrame:
    """Per arm and feature: F of the interaction in y ~ 1 + t + x + t*x.

    With both intercept and slope free in each arm this is the test that the two arms have
    the same slope, so the centred sums of each arm are all it needs: one pass over the
    table for all arms and features."""
    per = _within(df, cols, F.col(label).cast("double"), [arm])
    per = per.withColumns({
        "slope": F.try_divide(F.col("sxy"), F.col("sxx")),
        "rss": F.col("syy") - F.coalesce(F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")),
                                         F.lit(0.0))})
    base = per.where(F.col(arm) == control).select(
        "feature", F.col("n").alias("n0"), F.col("sxx").alias("sxx0"),
        F.col("slope").alias("slope0"), F.col("rss").alias("rss0"))
    both = per.where(F.col(arm) != control).join(base, "feature")
    d2 = F.col("n") + F.col("n0") - 4
    gap = F.col("slope") - F.col("slope0")
    spread = F.try_divide(F.lit(1.0), F.col("sxx")) + F.try_divide(F.lit(1.0), F.col("sxx0"))
    score = F.try_divide(gap * gap * d2, (F.col("rss") + F.col("rss0")) * spread)
    return both.select(F.col(arm).alias("arm"), "feature", F.col("n").alias("n_arm"), score.alias("score"),
                       F.lit(1).alias("d1"), d2.alias("d2"))


def uplift_f(df: DataFrame, cols: Sequence[str], arm: str, control, label: str,
             p_threshold: float = 0.05) -> DataFrame:
    """Mean p-value of each feature over the arms, weighted by arm size; a feature whose
    mean is above the threshold or undefined is not kept."""
    p = uplift_scores(df, cols, arm, control, label).withColumn(
        "p", f_pvalue(F.col("score"), F.col("d1"), F.col("d2")))
    # one undefined arm leaves the weighted mean undefined
    mean = F.when(F.count("p") == F.count(F.lit(1)), F.sum(F.col("p") * F.col("n_arm")) / F.sum("n_arm"))
    return (p.groupBy("feature").agg(mean.alias("p_value_mean"))
            .withColumn("keep", F.coalesce((F.col("p_value_mean") <= p_threshold).cast("int"), F.lit(0)))
            .orderBy(F.col("p_value_mean").asc_nulls_last(), "feature"))
