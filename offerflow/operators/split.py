"""Repeatable splits: the side of a row depends on its key and a seed, never on the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerflow.functions.expr import hash_order
from offerflow.operators.ordered import running
from offerflow.session import few_rows


def split_by_entity(df: DataFrame, keys: Sequence[str], frac: float, seed: int) -> DataFrame:
    """Adds ``is_train``; all rows of one key fall on the same side. No shuffle."""
    cut = int(frac * 2 ** 32)
    return df.withColumn("is_train", (hash_order(list(keys), seed) < cut).cast("int"))


random_split = split_by_entity


def stratified_split(df: DataFrame, keys: Sequence[str], stratum: str, frac: float,
                     seed: int) -> DataFrame:
    """Exactly round(frac * n) training rows in every stratum."""
    hashed = df.withColumn("_h", hash_order(list(keys), seed))
    ranked = running(hashed, ["_h", *keys], [stratum], uniform="_h")
    n = ranked.groupBy(F.col(stratum).alias("_s")).agg(F.max("rn").alias("_n"))
    return (ranked.join(few_rows(n), F.col(stratum).eqNullSafe(F.col("_s")))
            .withColumn("is_train", (F.col("rn") <= F.round(F.col("_n") * frac)).cast("int"))
            .drop("_s", "_n", "_h", "rn"))


def stratified_kfold(df: DataFrame, keys: Sequence[str], label: str, k: int, seed: int) -> DataFrame:
    """Adds ``fold`` 0..k-1 with the same label mix in every fold."""
    hashed = df.withColumn("_h", hash_order(list(keys), seed))
    ranked = running(hashed, ["_h", *keys], [label], uniform="_h")
    return ranked.withColumn("fold", F.pmod(F.col("rn") - 1, F.lit(k)).cast("int")).drop("_h", "rn")
