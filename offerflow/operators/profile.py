"""Counts, summaries and contingency tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerflow.operators.ordered import exact_quantiles


def long_summary(df: DataFrame, cols: Sequence[str], stats: Mapping[str, object],
                 by: Sequence[str] = ()) -> DataFrame:
    """One wide aggregate over all columns, turned to one row per feature (and group).

    ``stats`` maps an output name to a function column -> aggregate column."""
    aggs = [fn(F.col(c)).alias(f"{name}__{i}") for i, c in enumerate(cols)
            for name, fn in stats.items()]
    wide = df.groupBy(*by).agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"),
                 *[F.col(f"{name}__{i}").alias(name) for name in stats])
        for i, c in enumerate(cols)])
    return wide.select(*by, F.inline(rows))


def describe_features(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """count, mean, std, min, quartiles, max and missing percent per column. NaN counts as
    missing throughout."""
    num = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols]
    data = df.select(*num)
    stats = {
        "count": lambda c: F.count(c),
        "mean": lambda c: F.avg(c),
        "std": lambda c: F.stddev_samp(c),
        "min": lambda c: F.min(c),
        "max": lambda c: F.max(c),
        "miss_percent": lambda c: F.avg(F.when(c.isNull(), 1.0).otherwise(0.0)) * 100,
    }
    names = ["p25", "p50", "p75"]
    if approximate:
        stats["_q"] = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75])
        out = long_summary(data, cols, stats)
        return out.select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)]).drop("_q")
    q = exact_quantiles(data, cols, [0.25, 0.5, 0.75]).select(
        "feature", *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])
    return long_summary(data, cols, stats).join(q, "feature", "left")


def constant_features(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Features whose standard deviation is 0."""
    row = df.agg(*[F.stddev_samp(F.col(c)).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] == 0]


def drop_constant(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*constant_features(df, cols))


def label_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, a: str, b: str, b_values: Sequence, weight: str | None = None) -> DataFrame:
    """Contingency table; the columns are declared, so no extra pass looks for them."""
    w = F.col(weight) if weight else F.lit(1)
    return df.groupBy(a).agg(*[F.sum(F.when(F.col(b) == v, w)).alias(f"{b}_{v}")
                               for v in b_values])


def max_merge_labels(df: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in labels])


def item_labels(df: DataFrame, keys: Sequence[str], item: str, items: Sequence[str],
                label: str) -> DataFrame:
    """One 0/1 label per item: the label where the row is about that item."""
    return df.groupBy(*keys).agg(*[
        F.max(F.when(F.col(item) == i, F.col(label)).otherwise(0)).alias(f"{label}_{i}")
        for i in items])


def distinct_positives(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct().withColumn("label", F.lit(1))


def group_summary(df: DataFrame, group: Sequence[str], scores: Sequence[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n_users"),
                                  *[F.avg(c).alias(f"{c}_mean") for c in scores])


def traffic_report(df: DataFrame, item: str, items: Sequence[str], codes: Sequence[int],
                   ratios: Sequence[float]) -> DataFrame:
    """Realised count and share (3 decimals) next to the expected share, one row per item."""
    counts = df.agg(F.count(F.lit(1)).alias("total"),
                    *[F.count(F.when(F.col(item) == name, 1)).alias(f"_n{i}")
                      for i, name in enumerate(items)])
    rows = F.array(*[F.struct(F.lit(name).alias("item"), F.lit(int(code)).alias("item_code"),
                              F.lit(float(r)).alias("expected_ratio"),
                              F.col(f"_n{i}").alias("n_users"))
                     for i, (name, code, r) in enumerate(zip(items, codes, ratios))])
    return counts.select("total", F.inline(rows)).select(
        "item", "item_code", "expected_ratio", "n_users",
        F.round(F.try_divide("n_users", "total"), 3).alias("share"))


def tier_map(df: DataFrame, keys: Sequence[str], tier: str, amount: str,
             tiers: Mapping[int, str]) -> DataFrame:
    """(keys, tier, amount) to one JSON map per key, amounts in cents; tiers that a key
    lacks are left out. The tiers are known, so no list is collected."""
    cents = F.col(amount) * 100
    picked = df.groupBy(*keys).agg(*[
        F.max(F.when(F.col(tier) == t, F.round(cents).cast("int"))).alias(name)
        for t, name in tiers.items()])
    return picked.select(*keys, F.to_json(F.struct(*tiers.values())).alias("field"))


def weighted_mean_over_arms(df: DataFrame, metric: str, weight: str,
                            by: Sequence[str] = ()) -> DataFrame:
    has = F.col(metric).isNotNull()
    w = F.when(has, F.col(weight))
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(metric) * w), F.sum(w)).alias(f"{metric}_mean"))


def item_log_freq(df: DataFrame, item: str) -> DataFrame:
    """-ln(share of the item). The total is summed over the item counts."""
    counts = df.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    return counts.select(item, "n", (-F.ln(F.col("n") / F.lit(total))).alias("log_freq"))


def arm_shares(df: DataFrame, arm: str, control: str) -> DataFrame:
    """n_arm / (n_arm + n_control) per treatment arm."""
    counts = df.groupBy(arm).agg(F.count(F.lit(1)).alias("n"))
    n_control = df.where(F.col(arm) == control).count()
    return counts.where(F.col(arm) != control).select(
        arm, "n", (F.col("n") / (F.col("n") + F.lit(n_control))).alias("propensity"))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width counts of all bins, empty ones too, with the normal fit (mean and population std)
    beside them. A column without values gives no bins."""
    s = df.agg(F.min(col), F.max(col), F.avg(col), F.stddev_pop(col)).first()
    known = s[0] is not None
    lo, hi, mu, sigma = (float(x) if x is not None else 0.0 for x in s)
    width = (hi - lo) / bins or 1.0
    at = F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).cast("int")
    counts = (df.where(F.col(col).isNotNull()).groupBy(at.alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")))
    every = df.sparkSession.range(bins if known else 0).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * width).alias("left_edge"), F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        F.lit(mu).alias("mu"), F.lit(sigma).alias("sigma"))


def box_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Five-number summary per feature."""
    q = exact_quantiles(df, cols, [0.0, 0.25, 0.5, 0.75, 1.0])
    return q.select("feature", *[F.col(f"q{i}").alias(n) for i, n in
                                 enumerate(["low", "q1", "median", "q3", "high"])])


def count_summary(df: DataFrame, col: str, label: str, positive) -> DataFrame:
    """Rows and positive rows per category."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"),
                               F.count(F.when(F.col(label) == positive, 1)).alias("n_pos"))


def scatter_cells(df: DataFrame, x: str, y: str) -> DataFrame:
    """Points of a scatter plot with their multiplicity."""
    return (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
            .groupBy(x, y).agg(F.count(F.lit(1)).alias("n")))


def plot_data(df: DataFrame, col: str, kind: str, label: str | None = None, positive=1,
              bins: int = 20) -> DataFrame:
    """The numbers behind one plot: ``hist``, ``box``, ``count`` or ``scatter``."""
    if kind == "hist":
        return histogram(df, col, bins)
    if kind == "box":
        return box_summary(df, [col])
    if kind == "count" and label:
        return count_summary(df, col, label, positive)
    if kind == "scatter" and label:
        return scatter_cells(df, col, label)
    raise ValueError(f"unknown plot kind {kind!r}, or its label is missing")


def positive_effect_counts(df: DataFrame, arms: Sequence[str]) -> DataFrame:
    return long_summary(df, arms, {"n_positive": lambda c: F.sum(F.when(c > 0, 1).otherwise(0))}
                        ).withColumnRenamed("feature", "arm")
