"""Putting key tables together. No join here is quadratic, and none broadcasts a side
whose size was not checked; the rest is left to adaptive execution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerflow.operators.ranking import dedup_latest
from offerflow.session import shuffle_width, stage

LITERAL_ITEMS = 200
#: Salts per shuffle partition: hashing fills the partitions evenly, and the users of a salt are
#: few enough to come several times in a page of a written table.
SALTS = 16


def map_values_join(df: DataFrame, col: str, mapping: DataFrame, key: str, value: str,
                    out: str, default=None) -> DataFrame:
    """Dictionary replace with the dictionary as a table of any size."""
    m = mapping.select(F.col(key).alias("_k"), F.col(value).alias(out))
    joined = df.join(m, F.col(col) == F.col("_k"), "left").drop("_k")
    return joined if default is None else joined.fillna({out: default})


def keep_items(df: DataFrame, col: str, items: DataFrame) -> DataFrame:
    """Rows whose item is in the active item table."""
    active = items.select(F.col(items.columns[0]).alias("_k"))
    return df.join(active, F.col(col) == F.col("_k"), "left_semi")


def assemble_features(base: DataFrame, parts: Sequence[tuple[DataFrame, Sequence[str]]],
                      keys: Sequence[str]) -> DataFrame:
    """Left-join feature groups on the sample key. Each part comes with the order that
    picks its one row per key. Without an order the part must be unique; a key found twice is an
    error, which the join's own shuffle checks."""
    out = base
    for part, order in parts:
        one = dedup_latest(part, keys, order) if order else _unique(part, keys)
        used = [*keys, *[o.lstrip("-") for o in order]]
        features = [c for c in one.columns if c not in used]
        out = out.join(one.select(*keys, *features), list(keys), "left")
    return out


def _unique(part: DataFrame, keys: Sequence[str]) -> DataFrame:
    known = part.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    once = F.when(F.count(F.lit(1)).over(Window.partitionBy(*keys)) == 1, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"a part without an order has a key {list(keys)} twice")).cast("boolean"))
    return known.withColumn("_once", once).where("_once").drop("_once")


def join_rules_scores(ids: DataFrame, rules: Sequence[DataFrame],
                      scores: Sequence[DataFrame], key: str = "uid") -> DataFrame:
    """ids with the AND of every rule column and the product of every score column.

    A rule column that only some tables hold keeps its own value; one that several tables
    hold is combined, and is null when any of them has no row.
    """
    out = ids
    seen: dict[str, list[str]] = {}
    for i, part in enumerate([*rules, *scores]):
        cols = [c for c in part.columns if c != key]
        names = {c: f"{c}__{i}" for c in cols}
        out = out.join(part.select(key, *cols).withColumnsRenamed(names), key, "left")
        for c in cols:
            seen.setdefault(c, []).append(names[c])
    is_rule = {c for r in rules for c in r.columns if c != key}
    cols = []
    for c, names in seen.items():
        parts = [F.col(n) for n in names]
        both = (lambda a, b: a.bitwiseAND(b)) if c in is_rule else (lambda a, b: a * b)
        cols.append(reduce(both, parts).alias(c))
    return out.select(*ids.columns, *cols)


def union_feature_groups(a: DataFrame, b: DataFrame, keys: Sequence[str],
                         suffix: str = "_2") -> DataFrame:
    """Inner join of two feature groups; clashing names of the second get a suffix."""
    clash = {c: c + suffix for c in b.columns if c in a.columns and c not in keys}
    return a.join(b.withColumnsRenamed(clash), list(keys))


def check_alignment(tables: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Per table: distinct keys held, and keys it lacks that some other table holds.

    One tagged union and one aggregate by key, whatever the number of tables."""
    names = list(tables)
    tagged = reduce(
        lambda x, y: x.unionByName(y),
        [tables[n].select(*keys, F.lit(i).alias("_t")) for i, n in enumerate(names)])
    per_key = tagged.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_t") == i, 1).otherwise(0)).alias(f"_h{i}")
          for i in range(len(names))])
    sums = per_key.agg(
        F.count(F.lit(1)).alias("all_keys"),
        *[F.sum(f"_h{i}").alias(f"_h{i}") for i in range(len(names))])
    rows = F.array(*[F.struct(F.lit(n).alias("table_name"),
                              F.coalesce(F.col(f"_h{i}"), F.lit(0)).alias("keys_held"))
                     for i, n in enumerate(names)])
    return (sums.select("all_keys", F.inline(rows))
            .select("table_name", "keys_held",
                    (F.col("all_keys") - F.col("keys_held")).alias("keys_missing")))


def join_online_scores(scores: DataFrame, labels: DataFrame,
                       keys: Sequence[str]) -> DataFrame:
    return scores.join(labels, list(keys))


def expand_items(users: DataFrame, items: DataFrame, chunk: int = LITERAL_ITEMS) -> DataFrame:
    """Every user with every candidate item.

    The item list is counted first. Up to ``chunk`` items it is a literal array that each
    user row is exploded over: no shuffle and no broadcast. A longer list is packed into
    arrays of about ``chunk`` items. Users are shuffled once by a salt, every salt gets a copy of
    the arrays, and a sort-merge join on the salt pairs each item with the users of the salt: what is
    shuffled is the users and a fixed number of copies of the list, whatever the number of pairs, and
    neither list goes to the driver or whole to a broadcast.

    The items are on the side that is streamed. A written table then has an item as one run, over which the
    same users come again in the same order, and both compress; with the items on the other side every user
    is followed by the whole list, which is longer than a page, and nothing does.
    """
    n = items.count()
    if n <= chunk:
        structs = [F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name)
                              for f in items.schema.fields]) for row in items.collect()]
        if not structs:
            return users.select("*", *[F.lit(None).cast(f.dataType).alias(f.name)
                                       for f in items.schema.fields]).where(F.lit(False))
        return users.select("*", F.inline(F.array(*structs)))
    blocks, width = -(-n // chunk), shuffle_width(users)
    salts = width * SALTS
    # staged, for the numbers of a second run could differ
    numbered = stage(items.withColumn("_block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks))), "items")
    packed = numbered.groupBy("_block").agg(F.collect_list(F.struct(*items.columns)).alias("_items"))
    # a stated number of partitions is kept: small inputs, merged, would leave all pairs to one task
    it = (packed.select("_items", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
          .repartition(width, "_salt").select("_salt", F.inline("_items")))
    # eight neighbours share a salt: Parquet packs the bits of eight values at a time, so equal users give equal bytes
    rows = stage(users.withColumn("_row", F.monotonically_increasing_id()), "users")
    us = (rows.withColumn("_salt", F.pmod(F.xxhash64(F.shiftright("_row", 3)), F.lit(salts)).cast("int")).drop("_row")
          .repartition(width, "_salt"))
    return it.hint("merge").join(us, "_salt").select(*[us[c] for c in users.columns], *[it[c] for c in items.columns])


def anti_split(ids: DataFrame, train_ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ids.join(train_ids.select(*keys), list(keys), "left_anti")


def match_rate(base: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of the base rows whose key the other table holds."""
    found = other.select(*keys).distinct().withColumn("_found", F.lit(1))
    return base.select(*keys).join(found, list(keys), "left").agg(
        F.count(F.lit(1)).alias("base_rows"),
        F.count("_found").alias("matched"),
        F.try_divide(F.count("_found"), F.count(F.lit(1))).alias("match_rate"))
