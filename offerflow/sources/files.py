"""Tab-separated hand-off files and multi-file sample sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_tsv(spark: SparkSession, path: str, schema: StructType | str,
             header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="\t", header=header, encoding="UTF-8")


def export_tsv(df: DataFrame, path: str, header: bool = False,
               single_file: bool = False) -> None:
    """``single_file`` is for small hand-offs only: it writes through one task."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").csv(path, sep="\t", header=header, encoding="UTF-8")


def read_samples(spark: SparkSession, paths: Sequence[str],
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Weekly sample files united by column name, then cut to a column list."""
    frames = [spark.read.parquet(p) for p in paths]
    return unite_samples(frames, columns)


def unite_samples(frames: Sequence[DataFrame],
                  columns: Sequence[str] | None = None) -> DataFrame:
    if columns:
        frames = [f.select(*columns) for f in frames]
    return reduce(lambda a, b: a.unionByName(b), frames)


def select_features(df: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Keys and chosen features only; the scan then reads nothing else."""
    missing = [c for c in [*keys, *keep] if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    return df.select(*keys, *[c for c in keep if c not in keys])
