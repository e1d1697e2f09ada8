"""What the operators of this subpackage share: row keys, word patterns, staged tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

#: A word of the whitespace kind, as a Java and a Python pattern.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

KEY = ("_key_id", "_key_hash")


def text_of(text: str = "text") -> Column:
    """The text, null taken as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def group_key(name: str) -> Column:
    """A group's name as a join key: null is a group of its own."""
    return F.when(F.col(name).isNull(), F.lit("")).otherwise(
        F.concat(F.lit("="), F.col(name).cast("string")))


def row_key(docs: DataFrame, doc_id: str = "doc_id") -> list[Column]:
    """Columns that name a row by its content: rows alike in every column share a key."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)]
    return [F.col(doc_id).cast("string").alias(KEY[0]), F.xxhash64(*plain).alias(KEY[1])]


def pick_rows(docs: DataFrame, picked: DataFrame, copies: str, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` named by ``picked`` (row key, ``copies``), each key that many
    times in all, with the columns of ``docs``.

    Rows alike in every column share one key; the copies are dealt over them. Both sides
    meet in one shuffle on the key."""
    taken = (picked.groupBy(*KEY).agg(F.sum(copies).cast("long").alias("_m"))
             .filter("_m > 0"))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    keyed = docs.select(*row_key(docs, doc_id),
                        *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    on = [keyed[KEY[0]].eqNullSafe(taken[KEY[0]]), keyed[KEY[1]] == taken[KEY[1]]]
    joined = keyed.join(taken, on).select(keyed[KEY[0]], keyed[KEY[1]], "_m", *names)
    same = Window.partitionBy(*KEY)
    dealt = joined.select(
        *names, F.row_number().over(same.orderBy(KEY[1])).alias("_r"),
        F.count(F.lit(1)).over(same).alias("_n"), "_m")
    times = F.floor(F.col("_m") / F.col("_n")) + F.when(
        F.col("_r") <= F.col("_m") % F.col("_n"), 1).otherwise(0)
    many = dealt.withColumn("_t", times.cast("int")).filter("_t > 0")
    return many.withColumn("_e", F.explode(F.array_repeat(F.lit(0), F.col("_t")))).select(
        *[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def plain_columns(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the named columns, so that no other column can clash."""
    return docs.select(*[F.col(f"`{c}`").alias(c) for c in columns])


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    import sys

    return sys.__dict__.setdefault("_offerflow_llm", {}).setdefault(name, {})
