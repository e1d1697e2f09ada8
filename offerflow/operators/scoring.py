"""Applying a model to a table.

A model is any function from a feature matrix to a vector (or matrix) of outputs. It is
loaded once per task, inside the task, and sees Arrow batches holding the key and feature
columns only."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from offerflow.operators.joins import assemble_features
from offerflow.sources.partitions import read_partition, write_partition

Model = Callable[[np.ndarray], np.ndarray]


def _schema(df: DataFrame, keys: Sequence[str], outputs: Sequence[str]) -> StructType:
    return StructType([*[df.schema[k] for k in keys],
                       *[StructField(o, DoubleType()) for o in outputs]])


def score_batches(df: DataFrame, load_model: Callable[[], Model], features: Sequence[str],
                  keys: Sequence[str], outputs: Sequence[str] = ("score",)) -> DataFrame:
    """Keys with one double column per model output."""
    features, keys, outputs = list(features), list(keys), list(outputs)

    def run(batches):
        model = load_model()
        for batch in batches:
            out = np.asarray(model(batch[features].to_numpy(dtype="float64")), dtype="float64")
            out = out.reshape(len(batch), len(outputs))
            yield pd.concat([batch[keys].reset_index(drop=True),
                             pd.DataFrame(out, columns=outputs)], axis=1)

    return df.select(*keys, *[f for f in features if f not in keys]).mapInPandas(
        run, _schema(df, keys, outputs))


score_multi_output = score_batches


def score_items(users: DataFrame, load_model: Callable[[], Model], features: Sequence[str],
                keys: Sequence[str], items: Mapping[str, Sequence[float]], prefix: str = "score_") -> DataFrame:
    """One score column per item. The item's condition vector is put before the features
    inside the batch, so users are neither multiplied nor shuffled nor pivoted back."""
    features, keys = list(features), list(keys)
    outputs = [f"{prefix}{i}" for i in items]
    vectors = [np.asarray(v, dtype="float64") for v in items.values()]

    def run(batches):
        model = load_model()
        for batch in batches:
            x = batch[features].to_numpy(dtype="float64")
            cols = {o: np.asarray(model(np.hstack([np.broadcast_to(v, (len(x), len(v))), x]))).ravel()
                    for o, v in zip(outputs, vectors)}
            yield pd.concat([batch[keys].reset_index(drop=True), pd.DataFrame(cols)], axis=1)

    return users.select(*keys, *[f for f in features if f not in keys]).mapInPandas(
        run, _schema(users, keys, outputs))


def one_hot_items(items: Sequence[str]) -> dict[str, list[float]]:
    return {name: [1.0 if i == j else 0.0 for j in range(len(items))] for i, name in enumerate(items)}


def scores_long(wide: DataFrame, keys: Sequence[str], items: Sequence[str], prefix: str = "score_") -> DataFrame:
    return wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(i).alias("item"), F.col(f"{prefix}{i}").alias("score")) for i in items])))


def embedding_array(cols: Sequence[str]) -> Column:
    """An embedding held in separate columns as one array."""
    return F.array(*[F.col(c).cast("double") for c in cols])


#: Items and users of one block of pairs, about.
BLOCK_ITEMS, BLOCK_USERS = 1024, 2048


def _unit_rows(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as a matrix, their lengths)."""
    rows = np.asarray(vectors.flatten(), dtype="float64").reshape(-1, size)
    return rows, np.sqrt((rows * rows).sum(axis=1))


def _sigmoid_cosine(u: np.ndarray, u_norm: np.ndarray, v: np.ndarray, v_norm: np.ndarray) -> np.ndarray:
    cosine = (u @ v.T) / (u_norm[:, None] * v_norm + 1e-8)
    return 1.0 / (1.0 + np.exp(-np.clip(cosine, -1.0, 1.0)))


def score_embeddings(users: DataFrame, items: DataFrame, key: str, item: str, embedding: str,
                     names: Sequence, prefix: str = "score_") -> DataFrame:
    """Cosine-sigmoid score of every user with each of the declared items, one column per item.

    ``names`` declares the items, which bounds what the driver and every task hold: only they are
    fetched and travel with the task as one matrix. Each Arrow batch of users is one matrix product; the
    user table is read once and not shuffled. For lists of any length :func:`score_embedding_pairs`
    gives the same scores as rows."""
    names = list(names)
    found = {r[item]: r[embedding] for r in items.where(F.col(item).isin(names)).select(item, embedding).collect()}
    if set(found) != set(names):
        raise ValueError(f"items without a vector: {sorted(set(names) - set(found))}")
    matrix = np.array([[float(x) for x in found[n]] for n in names])
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    outputs = [f"{prefix}{n}" for n in names]

    def run(batches):
        for batch in batches:
            vectors = batch.column(1)
            there = np.asarray(vectors.is_valid())
            score = np.full((len(batch), len(outputs)), np.nan)
            score[there] = _sigmoid_cosine(*_unit_rows(vectors, matrix.shape[1]), matrix, norms)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(score[:, i], mask=~there) for i in range(len(outputs))]],
                names=[key, *outputs])

    return users.select(key, embedding).mapInArrow(run, _schema(users, [key], outputs))


def score_embedding_pairs(users: DataFrame, items: DataFrame, key: str, item: str, embedding: str,
                          block_items: int = BLOCK_ITEMS, block_users: int = BLOCK_USERS) -> DataFrame:
    """The same as (user, item, score) rows, for item lists of any length.

    Items and users are hashed into blocks of about the given numbers, and every block of users meets every
    block of items in a group of its own, which is one matrix product. Nothing is collected but the two
    numbers. A missing vector gives null scores."""
    item_blocks, user_blocks = max(1, -(-items.count() // block_items)), max(1, -(-users.count() // block_users))

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))

    packed = items.select(F.pmod(F.xxhash64(item), F.lit(item_blocks)).alias("_i"), F.col(item).alias("_item"),
                          F.col(embedding).alias("_v")).withColumn("_u", every(user_blocks))
    asking = users.select(F.pmod(F.xxhash64(key), F.lit(user_blocks)).alias("_u"), F.col(key).alias("_user"),
                          F.col(embedding).alias("_x")).withColumn("_i", every(item_blocks))
    shape = StructType([StructField(key, users.schema[key].dataType), StructField(item, items.schema[item].dataType),
                        StructField("score", DoubleType())])
    arrow = to_arrow_schema(shape)

    def product(left, right):
        out = []
        v, u = right.column("_v").combine_chunks(), left.column("_x").combine_chunks()
        names, users_ = right.column("_item").combine_chunks(), left.column("_user").combine_chunks()
        has_v, has_u = np.asarray(v.is_valid()), np.asarray(u.is_valid())
        if len(u) and len(v):
            score = np.full((len(u), len(v)), np.nan)
            if has_v.any() and has_u.any():
                v_rows, u_rows = v.drop_null(), u.drop_null()
                size = len(v_rows.flatten()) // len(v_rows)
                score[np.ix_(has_u, has_v)] = _sigmoid_cosine(*_unit_rows(u_rows, size), *_unit_rows(v_rows, size))
            flat = score.ravel()
            out = [users_.take(pa.array(np.repeat(np.arange(len(u)), len(v)))), names.take(pa.array(np.tile(np.arange(len(v)), len(u)))),
                   pa.array(flat, mask=np.isnan(flat))]
        return pa.Table.from_arrays(out, schema=arrow) if out else arrow.empty_table()

    return asking.groupBy("_i", "_u").cogroup(packed.groupBy("_i", "_u")).applyInArrow(product, shape)


def run_scoring_job(spark: SparkSession, people_path: str, feature_paths: Sequence[tuple[str, Sequence[str]]],
                    out_path: str, date: str, feature_date: str, key: str, load_model: Callable[[], Model],
                    features: Mapping[str, float], items: Sequence[str], exp_mode: str,
                    calibrate: Callable[[Column], Column]) -> None:
    """Read a dated people table, attach features with their defaults, score every item,
    calibrate, and replace the dated result partition. One shuffle per feature table."""
    people = read_partition(spark, people_path, date, [key])
    parts = [(read_partition(spark, path, feature_date, [key, *cols]), []) for path, cols in feature_paths]
    wide = assemble_features(people, parts, [key]).fillna(dict(features))
    scored = score_items(wide, load_model, list(features), [key], one_hot_items(items))
    final = scored.select(key, *[calibrate(F.col(f"score_{i}")).alias(f"score_{i}") for i in items])
    write_partition(final, out_path, date, exp_mode=exp_mode)
