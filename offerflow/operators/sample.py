"""Weighted negative sampling, drawn inside each (user, date) row."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerflow.operators.ordered import running
from offerflow.session import stage


def item_weights(df: DataFrame, item: str) -> DataFrame:
    """round(n_item / smallest n), half to even."""
    counts = df.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    least = counts.agg(F.min("n")).first()[0] or 1
    return counts.select(item, "n", F.bround(F.col("n") / F.lit(least)).cast("long").alias("weight"))


def _places(prefix: str, seed: int, k: int, starts: np.ndarray, weights: np.ndarray, size: int,
            copies: int, replacement: bool) -> np.ndarray:
    """Places in the whole list of item copies that ``k`` hashed draws hit. What the key holds
    (``starts``, ``weights``, rising) is passed over; without replacement so is each place
    that was drawn before."""
    at = np.array([int(hashlib.md5(f"{prefix}{j}|{seed}".encode()).hexdigest()[:8], 16)
                   for j in range(1, k + 1)], dtype=np.int64)
    starts, weights = starts * copies, weights * copies
    before = np.concatenate([[0], np.cumsum(weights)])
    free = starts - before[:-1]  # how many places not held lie before each held stretch
    if replacement:
        at %= size
    else:
        taken = np.zeros(0, dtype=np.int64)  # the i-th place drawn so far, less i
        for j in range(k):
            left = int(at[j]) % (size - j)
            i = int(np.searchsorted(taken, left, side="right"))
            at[j] = left + i
            taken = np.concatenate([taken[:i], [left], taken[i:] - 1])
    return (at + before[np.searchsorted(free, at, side="right")]) // copies


def negative_sample(positives: DataFrame, weights: Mapping | DataFrame, keys: Sequence[str],
                    item: str, ratio: int, replacement: bool, seed: int) -> DataFrame:
    """Distinct positives (label 1) and, per key, ``positives * ratio`` negatives (label 0).

    The negatives come from the items the key does not hold, each repeated by its weight.
    Without replacement the whole list is repeated often enough to supply the draws; a
    key that holds every item has no pool and gets none. ``weights`` is a table (item,
    weight) of any length, or a mapping.

    Items are laid end to end by their running weight. A key draws places of that line, for which it
    needs no more than the stretches of its own items; places become items by a range
    join on even bins. Nothing depends on the number of items but that join.
    """
    spark = positives.sparkSession
    if isinstance(weights, Mapping):
        kind = positives.schema[item].dataType.simpleString()
        weights = spark.createDataFrame([(k, int(v)) for k, v in weights.items()], f"{item} {kind}, weight long")
    weighed = weights.select(F.col(item).alias("_item"), F.col("weight").cast("long").alias("_w")).where("_w > 0")
    line = running(weighed, ["_item"], sums=["_w"], rank="_rn").select(
        "_item", "_w", (F.col("cum__w") - F.col("_w")).alias("_start"))
    line = stage(line, "catalogue")
    total, n = line.agg(F.coalesce(F.sum("_w"), F.lit(0)), F.count(F.lit(1))).first()
    width = max(1, -(-total // max(n, 1)))

    distinct = positives.select(*keys, F.col(item).alias("_held")).distinct()
    stretches = distinct.join(line, F.col("_held") == F.col("_item"), "left")
    prefix = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(""))
    held = stretches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sort_array(F.collect_list(F.when(F.col("_item").isNotNull(), F.struct("_start", "_w")))).alias("_own"))
    rows = held.select(*keys, prefix.alias("_prefix"), "_n", F.col("_own._start").alias("_starts"), F.col("_own._w").alias("_ws"))

    def draw(batches):
        for batch in batches:
            at = len(keys)
            out = []
            for prefix, held_n, starts, ws in zip(*[batch.column(at + i).to_pylist() for i in range(4)]):
                size = total - sum(ws)
                k = held_n * ratio if size > 0 else 0
                copies = 1 if replacement else k // max(size, 1) + 1
                out.append(_places(prefix, seed, k, np.array(starts, dtype=np.int64), np.array(ws, dtype=np.int64),
                                   size * copies, copies, replacement) if k else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.list_(pa.int64()))],
                                             names=[*keys, "_places"])

    schema = ", ".join(f"`{k}` {positives.schema[k].dataType.simpleString()}" for k in keys)
    drawn = rows.mapInArrow(draw, f"{schema}, _places array<long>").select(*keys, F.explode("_places").alias("_at"))
    bins = line.withColumn("_bin", F.explode(F.sequence(
        F.floor(F.col("_start") / width), F.floor((F.col("_start") + F.col("_w") - 1) / width))))
    hits = drawn.withColumn("_bin", F.floor(F.col("_at") / width)).join(bins, "_bin").where(
        (F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_start") + F.col("_w")))
    return distinct.select(*keys, F.col("_held").alias(item), F.lit(1).alias("label")).unionByName(
        hits.select(*keys, F.col("_item").alias(item), F.lit(0).alias("label")))
