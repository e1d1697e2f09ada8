"""Registry of queries: a Spark plan and, where SQL can say it, the same thing in SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from offerflow.plans.views import SPARK_VIEWS, VIEWS, tables_of


class Inputs:
    """Tables and input views by attribute: ``t.orders``, ``t.fx_score``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in VIEWS:
            text = SPARK_VIEWS.get(name, VIEWS[name])
            return self.spark.sql(text, **{t: getattr(self, t) for t in tables_of(text)})
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    run: Callable[[Inputs], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(sql: str | None = None, views: Sequence[str] = (), name: str | None = None):
    """Register a plan under its function name, with its SQL twin over ``views``."""

    def add(fn: Callable[[Inputs], DataFrame]):
        key = name or fn.__name__
        if key in CATALOG:
            raise ValueError(f"query {key} is registered twice")
        CATALOG[key] = Query(fn, with_views(views, sql) if sql else None)
        return fn

    return add


def with_views(views: Sequence[str], body: str) -> str:
    if not views:
        return body
    ctes = []
    for v in views:
        text = VIEWS[v]
        ctes.append(f"{v} AS ({text.format(**{t: t for t in tables_of(text)})})")
    body = body.strip()
    if body[:5].upper() == "WITH ":
        recursive = body[5:].lstrip().upper().startswith("RECURSIVE ")
        rest = body[5:].lstrip()
        if recursive:
            return "WITH RECURSIVE " + ", ".join(ctes) + ", " + rest[10:]
        return "WITH " + ", ".join(ctes) + ", " + rest
    return "WITH " + ", ".join(ctes) + " " + body
