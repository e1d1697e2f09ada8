"""Ranks, running sums and quantiles in a total order, for groups of any size.

A plain ``Window.partitionBy(group).orderBy(...)`` puts a whole group into one task, and
a window without a group puts the whole table there. Here rows are range-partitioned by
(group, order) instead, so a hot group is spread over many chunks:

1. range-partition on (group, order) and remember the chunk number;
2. rank and sum inside each (chunk, group), and stage the result;
3. add what the group had in earlier chunks. Chunks follow the order, so only the first
   group of a chunk can have begun earlier: at most one row per chunk to add, which is
   broadcast. The result is a scan of the staged table and can be read many times.

The order must be total, so that equal scores are also spread: end it with an id.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerflow.session import few_rows, shuffle_width, stage

CHUNK = "_chunk"


def order_columns(order: Sequence[str]) -> list[Column]:
    """``"-x"`` means x descending, ``"x"`` ascending."""
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def running(df: DataFrame, order: Sequence[str], by: Sequence[str] = (),
            sums: Sequence[str] = (), maxes: Sequence[str] = (), rank: str = "rn",
            partitions: int | None = None, uniform: str | None = None) -> DataFrame:
    """Adds the 1-based ``rank`` and, per column c, ``cum_c`` (running sum including the
    row) or ``prev_max_c`` (running maximum excluding the row).

    ``uniform`` names the first order column when it is a hash in 0 .. 2^32-1 (see
    :func:`offerflow.functions.expr.hash_order`): its range is then cut evenly, which needs
    neither a sample of the data nor a range shuffle."""
    by = list(by)
    n = partitions or shuffle_width(df)
    if uniform:
        placed = df.withColumn(CHUNK, F.floor(F.col(uniform) * n / 2 ** 32).cast("int"))
    else:
        placed = (df.repartitionByRange(n, *[F.col(b) for b in by], *order_columns(order))
                  .withColumn(CHUNK, F.spark_partition_id()))
    ordered = Window.partitionBy(CHUNK, *by).orderBy(*order_columns(order))
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    local = stage(placed.select(
        "*",
        F.row_number().over(ordered).cast("long").alias("_r"),
        *[F.sum(c).over(upto).alias(f"_s_{c}") for c in sums],
        *[F.max(c).over(before).alias(f"_m_{c}") for c in maxes],
    ), "ordered")
    if uniform:
        offsets = few_rows(_offsets_of_all(local, by, sums, maxes))
    else:
        offsets = F.broadcast(_offsets(local, by, sums, maxes))
    on = F.col(CHUNK) == F.col("_c")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_b{i}"))

    def plus(a: str, b: str) -> Column:
        return F.when(F.col(b).isNull(), F.col(a)).otherwise(
            F.coalesce(F.col(a), F.lit(0)) + F.col(b))

    return local.join(offsets, on, "left").select(
        *df.columns,
        (F.col("_r") + F.coalesce("_o", F.lit(0))).alias(rank),
        *[plus(f"_s_{c}", f"_os_{c}").alias(f"cum_{c}") for c in sums],
        *[F.greatest(f"_m_{c}", f"_om_{c}").alias(f"prev_max_{c}") for c in maxes],
    )


def _totals(sums: Sequence[str], maxes: Sequence[str]) -> list[Column]:
    return [F.col("_r").alias("_n"), *[F.col(f"_s_{c}").alias(f"_t_{c}") for c in sums],
            *[F.greatest(f"_m_{c}", c).alias(f"_x_{c}") for c in maxes]]


def _offsets_of_all(local: DataFrame, by: Sequence[str], sums: Sequence[str],
                    maxes: Sequence[str]) -> DataFrame:
    """Offsets where every group is spread over all chunks: one row per chunk and group."""
    keys = [f"_b{i}" for i in range(len(by))]
    last = local.groupBy(CHUNK, *[F.col(b).alias(k) for b, k in zip(by, keys)]).agg(
        F.max_by(F.struct(*_totals(sums, maxes)), "_r").alias("_l")).select(CHUNK, *keys, "_l.*")
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return last.select(
        F.col(CHUNK).alias("_c"), *keys, F.sum("_n").over(earlier).alias("_o"),
        *[F.sum(f"_t_{c}").over(earlier).alias(f"_os_{c}") for c in sums],
        *[F.max(f"_x_{c}").over(earlier).alias(f"_om_{c}") for c in maxes])


def _offsets(local: DataFrame, by: Sequence[str], sums: Sequence[str],
             maxes: Sequence[str]) -> DataFrame:
    """What the first group of each chunk had before it: at most one row per chunk.

    The last group of a chunk is the only one that can go on, so its totals, added up over
    the chunks it fills, are the offset in the chunk that follows."""
    group = [F.col(b).alias(f"_b{i}") for i, b in enumerate(by)]
    last = local.groupBy(CHUNK).agg(F.max_by(
        F.struct(*group, *_totals(sums, maxes)), F.struct(*by, "_r")).alias("_l")).select(CHUNK, "_l.*")
    chunks = Window.orderBy(CHUNK)
    filled = Window.partitionBy(*[f"_b{i}" for i in range(len(by))]).orderBy(CHUNK).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return last.select(
        F.lead(CHUNK).over(chunks).alias("_c"), *[f"_b{i}" for i in range(len(by))],
        F.sum("_n").over(filled).alias("_o"),
        *[F.sum(f"_t_{c}").over(filled).alias(f"_os_{c}") for c in sums],
        *[F.max(f"_x_{c}").over(filled).alias(f"_om_{c}") for c in maxes],
    ).where(F.col("_c").isNotNull())


def unpivot(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (),
            name: str = "feature", value: str = "value") -> DataFrame:
    """Numeric columns as (name, value) rows; the array is built and exploded in one
    codegen stage, only ``keep`` and ``cols`` are read."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value))
                      for c in cols])
    return df.select(*keep, F.inline(pairs))


def quantiles_of_counts(counts: DataFrame, probs: Sequence[float], by: Sequence[str],
                        value: str = "value", n: str = "n") -> DataFrame:
    """Exact linear-interpolation quantiles from (group, value, count) rows.

    One output row per group: ``total`` and ``q0 .. qk`` for the given ``probs``.
    """
    by = list(by)
    cum = running(counts, [value], by, sums=[n])
    totals = cum.groupBy(*by).agg(F.max(f"cum_{n}").alias("total"))
    if by:
        right = totals.select(*[F.col(b).alias(f"_t_{b}") for b in by], "total")
        on = [F.col(b).eqNullSafe(F.col(f"_t_{b}")) for b in by]
        cum = cum.join(few_rows(right), on).drop(*[f"_t_{b}" for b in by])
    else:
        cum = cum.withColumn("total", F.lit(totals.first()[0] or 0).cast("long"))
    first = F.col(f"cum_{n}") - F.col(n)
    picks = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("total") - 1)
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (first <= at) & (at < F.col(f"cum_{n}"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"_{side}{i}"))
    out = cum.groupBy(*by).agg(F.max("total").alias("total"), *picks)
    cols = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("total") - 1)
        frac = pos - F.floor(pos)
        cols.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac)
                    .alias(f"q{i}"))
    return out.select(*by, "total", *cols)


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles per (group, feature): ``total`` and ``q0 .. qk``.

    Without groups nothing is ordered or shuffled: the values at the wanted ranks are found
    by :func:`values_at_ranks`. With groups, equal values are counted before they are moved.
    """
    if by:
        counts = (unpivot(df, cols, by).where(F.col("value").isNotNull() & ~F.isnan("value"))
                  .groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("n")))
        return quantiles_of_counts(counts, probs, [*by, "feature"])
    totals, ranked = values_at_ranks(df, cols, lambda n: {
        r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    rows = []
    for c in cols:
        if not totals[c]:
            continue
        at = [p * (totals[c] - 1) for p in probs]
        lo = [ranked[c][math.floor(x)] for x in at]
        hi = [ranked[c][math.ceil(x)] for x in at]
        rows.append((c, totals[c], *[_between(a, b, x - math.floor(x)) for a, b, x in zip(lo, hi, at)]))
    schema = "feature string, total long, " + ", ".join(f"q{i} double" for i in range(len(probs)))
    return df.sparkSession.createDataFrame(rows, schema)


def _between(a: float, b: float, share: float) -> float:
    """Linear interpolation that carries infinities through."""
    return a if share == 0 or a == b else a + (b - a) * share


def values_at_ranks(df: DataFrame, cols: Sequence[str], ranks: Callable[[int], set[int]],
                    cells: int = 200_000) -> tuple[dict[str, int], dict[str, dict[int, float]]]:
    """Exact order statistics of several columns: counts, and value per wanted 0-based rank.

    The interval that holds a rank is cut into equal buckets, counted in one aggregate for
    all columns and ranks, and narrowed to the bucket's own smallest and largest value,
    until they are the same. Buckets are even in value and in magnitude by turns, so that
    neither narrow nor widely scattered columns need more than a few passes. A few scans of
    the columns replace a sort; at most about ``cells`` counts reach the driver.
    """
    clean = {c: _finite(F.col(c).cast("double")) for c in cols}
    whole = df.agg(*[f(v).alias(f"{name}{i}") for i, v in enumerate(clean.values())
                     for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))],
                   *[F.count_if(F.col(c).cast("double") == x).alias(f"{name}{i}") for i, c in enumerate(cols)
                     for name, x in (("below", -math.inf), ("above", math.inf))]).first()
    totals = {c: whole[f"below{i}"] + whole[f"n{i}"] + whole[f"above{i}"] for i, c in enumerate(cols)}
    found: dict[str, dict[int, float]] = {c: {} for c in cols}
    # per column: (smallest value, largest value, rows before, wanted ranks)
    todo = {}
    for i, c in enumerate(cols):
        low, high = whole[f"below{i}"], whole[f"below{i}"] + whole[f"n{i}"]
        wanted = sorted(ranks(totals[c])) if totals[c] else []
        found[c].update({r: -math.inf if r < low else math.inf for r in wanted if not low <= r < high})
        if inner := [r for r in wanted if low <= r < high]:
            todo[i] = [(whole[f"lo{i}"], whole[f"hi{i}"], low, inner)]
    names = list(cols)
    for turn in itertools.count():
        for i, spans in todo.items():
            for lo, hi, _, wanted in spans:
                if lo == hi:
                    found[names[i]].update({r: lo for r in wanted})
            todo[i] = [s for s in spans if s[0] != s[1]]
        todo = {i: spans for i, spans in todo.items() if spans}
        if not todo:
            return totals, found
        buckets = max(16, min(1024, cells // sum(len(s) for s in todo.values())))
        counts = _span_counts(df, clean, names, todo, buckets, by_size=turn % 2 == 1)
        todo = {i: _narrowed(spans, counts.get(i, {})) for i, spans in todo.items()}


def _finite(v: Column) -> Column:
    """Null for NaN, which counts as missing, and for infinities, which are counted apart."""
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= sys.float_info.max), v)


def _size(x: float) -> float:
    """Logarithm of the magnitude, above 0 for every double, with the sign of x."""
    return math.copysign(math.log(abs(x)) + 746.0, x) if x else 0.0


def _span_counts(df: DataFrame, clean: dict, names: list[str], todo: dict, buckets: int,
                 by_size: bool) -> dict:
    """column -> span -> sorted (bucket, rows, smallest, largest).

    The spans are literal arrays looked up by column, so the expression stays the same size
    for any number of columns and ranks."""
    low, high, scale, start, width = [], [], [], [], []
    for i in range(len(names)):
        spans = todo.get(i, [])
        low.append([s[0] for s in spans])
        high.append([s[1] for s in spans])
        # halves keep the width of a span finite over the whole range of doubles
        scale.append([0.5 if math.isinf(s[1] - s[0]) and not by_size else 1.0 for s in spans])
        ends = [(_size(s[0]), _size(s[1])) if by_size else (s[0] * f, s[1] * f)
                for s, f in zip(spans, scale[-1])]
        start.append([e[0] for e in ends])
        width.append([(e[1] - e[0]) / buckets or e[1] - e[0] or 1.0 for e in ends])

    def table(rows):
        return F.array(*[F.array(*[F.lit(x) for x in r]).cast("array<double>") for r in rows])

    def at(rows):
        return F.get(F.get(table(rows), F.col("i")), F.col("k"))

    pairs = F.array(*[F.struct(F.lit(i).alias("i"), clean[names[i]].alias("v")) for i in todo])
    v = F.col("v")
    rows = df.select(F.inline(pairs)).where(v.isNotNull())
    rows = rows.withColumn("k", F.size(F.filter(F.get(table(low), F.col("i")), lambda x: x <= F.col("v"))) - 1)
    rows = rows.where((F.col("k") >= 0) & (v <= at(high)))
    if by_size:
        place = F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.ln(F.abs(v)) + 746.0))
    else:
        place = v * at(scale)
    bucket = F.floor((place - at(start)) / at(width))
    bucket = F.greatest(F.lit(0), F.least(bucket, F.lit(buckets - 1))).cast("int")
    counts = rows.groupBy("i", "k", bucket.alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    out: dict = {}
    for r in counts:
        out.setdefault(r["i"], {}).setdefault(r["k"], []).append((r["b"], r["n"], r["lo"], r["hi"]))
    return {i: {k: sorted(c) for k, c in spans.items()} for i, spans in out.items()}


def _narrowed(spans: list, counts: dict) -> list:
    """The bucket of every wanted rank as its new span."""
    out = []
    for k, (_, _, before, wanted) in enumerate(spans):
        left = list(wanted)
        for _, n, lo, hi in counts.get(k, []):
            here = [r for r in left if r < before + n]
            if here:
                out.append((lo, hi, before, here))
                left = left[len(here):]
            before += n
    return out


def average_ranks(counts: DataFrame, value: str, n: str = "n",
                  by: Sequence[str] = ()) -> DataFrame:
    """Adds ``avg_rank``: the mean 1-based rank of each run of equal values."""
    cum = running(counts, [value], by, sums=[n])
    return cum.select(*counts.columns, (F.col(f"cum_{n}") - (F.col(n) - 1) / 2)
                      .cast("double").alias("avg_rank"))
