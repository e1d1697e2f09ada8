"""Fitted encoders. Fitting is one aggregate; applying is a projection wherever the fitted
part is small enough to be a literal, else a join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerflow.operators.ordered import running
from offerflow.session import stage


def _sort_keys(df: DataFrame, col: str) -> list[Column]:
    """(whole, real): exact for integers, dates and times in ``whole``, else a double in ``real``;
    both null for text."""
    kind, c = dict(df.dtypes)[col], F.col(col)
    whole = {"date": F.unix_date(c), "timestamp": F.unix_micros(c)} if kind in ("date", "timestamp") else {
        k: c for k in ("tinyint", "smallint", "int", "bigint", "boolean")}
    number = kind in ("float", "double") or kind.startswith("decimal")
    return [(whole[kind].cast("long") if kind in whole else F.lit(None).cast("long")).alias("whole"),
            (c.cast("double") if number else F.lit(None).cast("double")).alias("real")]


@dataclass(frozen=True)
class LabelEncoder:
    """Sorted distinct values of each column as 0 .. k-1.

    The codes stay in a staged table and are joined, so no column size is a limit.
    """

    codes: Mapping[str, DataFrame]

    @staticmethod
    def fit(df: DataFrame, cols: Sequence[str]) -> LabelEncoder:
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                          for c in cols])
        # values must sort as what they are, so sort keys are kept beside the text
        keys = F.array(*[F.struct(*_sort_keys(df, c)) for c in cols])
        distinct = (df.select(F.posexplode(F.arrays_zip(pairs.alias("p"), keys.alias("k"))))
                    .select("col.p.*", "col.k.whole", "col.k.real")
                    .where(F.col("value").isNotNull()).distinct())
        codes = stage(running(distinct, ["whole", "real", "value"], ["feature"], rank="rn")
                      .select("feature", "value", (F.col("rn") - 1).cast("int").alias("code")),
                      "codes")
        return LabelEncoder({c: codes.where(F.col("feature") == c).select("value", "code") for c in cols})

    def transform(self, df: DataFrame, unseen: int = -1, suffix: str = "") -> DataFrame:
        """Null and unseen values get ``unseen`` (0 in online use, -1 offline)."""
        out = df
        for c, table in self.codes.items():
            codes = table.select(F.col("value").alias("_v"), F.col("code").alias("_code"))
            out = (out.join(codes, F.col(c).cast("string") == F.col("_v"), "left")
                   .withColumn(c + suffix, F.coalesce("_code", F.lit(unseen)))
                   .drop("_v", "_code"))
        return out


@dataclass(frozen=True)
class StandardScaler:
    """(x - mean) / population std; a std of 0 counts as 1."""

    stats: Mapping[str, tuple[float, float]]

    @staticmethod
    def fit(df: DataFrame, cols: Sequence[str]) -> StandardScaler:
        row = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols
                       for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        return StandardScaler({c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in cols
                               if row[f"m_{c}"] is not None})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(float(m))) / F.lit(float(s))
                               for c, (m, s) in self.stats.items()})


@dataclass(frozen=True)
class MinMaxScaler:
    """(x - min) / (max - min), fitted on one table and applied to others."""

    stats: Mapping[str, tuple[float, float]]

    @staticmethod
    def fit(df: DataFrame, cols: Sequence[str]) -> MinMaxScaler:
        row = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols
                       for n, f in (("lo", F.min), ("hi", F.max))]).first()
        return MinMaxScaler({c: (float(row[f"lo_{c}"]), float(row[f"hi_{c}"])) for c in cols
                             if row[f"lo_{c}"] is not None})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(lo)) / F.lit((hi - lo) or 1.0)
                               for c, (lo, hi) in self.stats.items()})


def one_hot(df: DataFrame, col: str, values: Sequence[str] | None = None) -> DataFrame:
    """0/1 column ``col_value`` per value: the declared ``values``, else all distinct ones. Every
    value becomes a column; a column with very many values is better label-encoded."""
    text = F.col(col).cast("string")
    if values is None:
        rows = df.select(text.alias("v")).where("v IS NOT NULL").distinct().collect()
        values = sorted(r["v"] for r in rows)
    return df.withColumns({f"{col}_{v}": F.when(text == v, 1).otherwise(0) for v in values})


def split_low_card(df: DataFrame, cols: Sequence[str], k: int = 25) -> tuple[list[str], list[str]]:
    """(sparse, dense): columns with at most k distinct values, and the others."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                      for c in cols])
    counts = (df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()
              .groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect())
    n = {r["feature"]: r["n"] for r in counts}
    sparse = [c for c in cols if n.get(c, 0) <= k]
    return sparse, [c for c in cols if c not in sparse]


def transform_features(df: DataFrame, keys: Sequence[str], encoder: LabelEncoder,
                       scaler: StandardScaler, unseen: int = 0) -> DataFrame:
    """Keys, codes and scaled features as one projection with plain types."""
    coded = scaler.transform(encoder.transform(df, unseen))
    sparse, dense = list(encoder.codes), list(scaler.stats)
    return coded.select(*keys, *[F.col(c).cast("int").alias(c) for c in sparse],
                        *[F.col(c).cast("double").alias(c) for c in dense])
