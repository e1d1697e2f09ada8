"""Sharding by a hierarchical weighted hash tree.

A row's key descends region, rack and shard levels. At every node each child draws
``-ln(u) / weight`` with ``u`` from a hash of key and child, and the smallest draw wins, so a
child gets keys in proportion to its weight. Draws of other children do not depend on a
child's weight: when weights change, keys move only into (or out of) the subtrees whose
weights changed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerflow.llm.common import plain_columns, text_of
from offerflow.operators.ordered import running

#: region -> rack -> shard -> weight
Tree = Mapping[int, Mapping[int, Mapping[int, float]]]


def even_tree(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> Tree:
    """Shards of weight 1, filled rack by rack and region by region. A shard that opens a
    region takes keys into itself only."""
    tree: dict[int, dict[int, dict[int, float]]] = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(rack // racks_per_region, {}).setdefault(rack, {})[s] = 1.0
    return tree


def _draw(key: Column, node: str, weight: float) -> Column:
    # 48 bits of the digest, moved off zero, so that ln is finite
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{node}")).cast("binary")), 1, 12), 16, 10)
    return -F.ln((bits.cast("double") + 0.5) / F.lit(2.0 ** 48)) / F.lit(float(weight))


def _winner(key: Column, level: str, weights: Mapping[int, float]) -> Column:
    open_ = {c: w for c, w in weights.items() if w > 0}
    if len(open_) == 1:
        return F.lit(next(iter(open_)))
    draws = [F.struct(_draw(key, f"{level}{c}", w).alias("d"), F.lit(c).alias("c"))
             for c, w in sorted(open_.items())]
    return F.least(*draws)["c"]


def _weight(children) -> float:
    return sum(_weight(c) if isinstance(c, Mapping) else c for c in children.values())


def _chosen(parent: Column, options: Mapping[int, Column]) -> Column:
    items = sorted(options.items())
    out = None
    for value, column in items:
        out = F.when(parent == value, column) if out is None else out.when(parent == value, column)
    return out


def place(df: DataFrame, key: Column, tree: Tree, name: str = "shard") -> DataFrame:
    """``df`` with the shard of ``key`` (null keys go where the empty key goes).

    Three narrow projections of SQL functions, one per level; only the children of the chosen
    node draw. The plan grows with the number of nodes, so it suits trees of some thousand
    shards at most."""
    if _weight(tree) <= 0:
        raise ValueError("the tree has no weight")
    k = F.coalesce(key.cast("string"), F.lit(""))
    region = _winner(k, "region", {r: _weight(racks) for r, racks in tree.items()})
    live = {r: {k_: v for k_, v in racks.items() if _weight(v) > 0} for r, racks in tree.items()}
    live = {r: racks for r, racks in live.items() if racks}
    out = df.withColumn("_region", region)
    rack = _chosen(F.col("_region"), {r: _winner(k, "rack", {c: _weight(s) for c, s in racks.items()})
                                      for r, racks in live.items()})
    out = out.withColumn("_rack", rack)
    shard = _chosen(F.col("_rack"), {c: _winner(k, "shard", s)
                                     for racks in live.values() for c, s in racks.items()})
    return out.withColumn(name, shard.cast("int")).drop("_region", "_rack")


def assign_shards(docs: DataFrame, tree: Tree, grown: Tree | None = None, doc_id: str = "doc_id",
                  text: str = "text", also: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard and the
    columns named by ``also``.

    The law is ``key``: doc_id and tree decide, nothing else. ``slot`` numbers a shard's rows
    from 0 by doc_id (nulls first), checksum and size; it comes from range-partitioned ranks,
    so a shard is never one task. Null text has size 1 and the checksum of empty text; rows
    with a null doc_id share a shard; repeated rows get slots of their own; an empty table
    gives no rows. Other columns of ``docs`` are not read."""
    body = text_of(text)
    rows = plain_columns(docs, [doc_id, text, *also]).select(
        F.col(doc_id).alias("doc_id"), *also,
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    placed = place(rows, F.col("doc_id"), tree)
    placed = (place(placed, F.col("doc_id"), grown, "grown_shard") if grown is not None
              else placed.withColumn("grown_shard", F.lit(None).cast("int")))
    ranked = running(placed, ["doc_id", "text_crc32", "size"], by=["shard"], rank="_slot")
    return ranked.select("doc_id", *also, "size", "text_crc32", "law", "shard",
                         (F.col("_slot") - 1).alias("slot"), "grown_shard")
