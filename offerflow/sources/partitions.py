"""Dated tables: year / month / day (and role, exp_mode) as string partition columns."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

DATE_PARTS = ("year", "month", "day")


def date_parts(date: str | dt.date) -> dict[str, str]:
    day = dt.date.fromisoformat(date) if isinstance(date, str) else date
    return {"year": f"{day:%Y}", "month": f"{day:%m}", "day": f"{day:%d}"}


def _folder(path: str, parts: dict[str, str]) -> str:
    for name, value in parts.items():
        if not re.fullmatch(r"[\w.-]+", value):
            raise ValueError(f"not a partition value: {name}={value!r}")
    return "/".join([path.rstrip("/"), *[f"{k}={v}" for k, v in parts.items()]])


def _listed(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, none if there is no such folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def _levels_below(spark: SparkSession, folder: str) -> list[str]:
    """Names of the partition levels under a folder, from its first branch."""
    for name in _listed(spark, folder):
        if "=" in name and not name.startswith(("_", ".")):
            return [name.split("=", 1)[0], *_levels_below(spark, f"{folder}/{name}")]
    return []


def read_partition(spark: SparkSession, path: str, date: str | dt.date,
                   columns: list[str] | None = None, **parts: str) -> DataFrame:
    """One dated partition. Only its own folder is listed and read. ``parts`` name the levels
    below the day from the top; levels left out are kept as string columns."""
    wanted = {**date_parts(date), **{k: str(v) for k, v in parts.items()}}
    folder = _folder(path, wanted)
    reader = spark.read.option("basePath", folder)
    levels = _levels_below(spark, folder)
    if levels:  # partition values stay strings ("01"), whatever the session infers
        plain = spark.read.option("basePath", folder).parquet(folder).schema
        reader = reader.schema(StructType([f for f in plain if f.name not in levels]
                                          + [StructField(n, StringType()) for n in levels]))
    df = reader.parquet(folder)
    return df.select(*columns) if columns else df


def write_partition(df: DataFrame, path: str, date: str | dt.date, **parts: str) -> None:
    """Replace exactly one partition; running it twice leaves one copy, and an empty result
    leaves an empty partition."""
    fixed = {**date_parts(date), **{k: str(v) for k, v in parts.items()}}
    df.drop(*fixed).write.mode("overwrite").parquet(_folder(path, fixed))


def carry_forward(spark: SparkSession, path: str, source: str | dt.date,
                  target: str | dt.date, **parts: str) -> None:
    """Publish an earlier day's result again under a later date. Levels below the day that are
    not named are carried over as they are, each replacing its own partition."""
    given = {k: str(v) for k, v in parts.items()}
    old, new = ({**date_parts(d), **given} for d in (source, target))
    levels = _levels_below(spark, _folder(path, date_parts(source)))
    if list(given) != levels[:len(given)]:
        raise ValueError(f"the table's levels below the day are {levels}, not {list(given)}")
    rest = levels[len(given):]
    df = read_partition(spark, path, source, **given)
    writer = df.write.mode("overwrite")
    if rest:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*rest)
    elif old == new:
        return
    writer.parquet(_folder(path, new))
