"""Banding of numeric features, and weight of evidence per band.

Fitting looks at the table as (value, count) totals; what it returns is a short list of
cut points, applied as one right-closed CASE ladder."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerflow.operators.ordered import exact_quantiles, running
from offerflow.session import stage


@dataclass(frozen=True)
class Bands:
    """Bands (e0, e1], (e1, e2] ...; null outside. ``closed_start`` puts e0 into band 0."""

    edges: tuple[float, ...]
    closed_start: bool = False

    def index(self, x: Column) -> Column:
        if len(self.edges) < 2:
            only = F.lit(0) if self.edges and self.closed_start else F.lit(None).cast("int")
            return F.when(x == (self.edges[0] if self.edges else 0.0), only).cast("int")
        first = self.edges[0]
        below = (x < first) if self.closed_start else (x <= first)
        out = F.when(x.isNull() | F.isnan(x) | below, F.lit(None).cast("int"))
        for i, edge in enumerate(self.edges[1:]):
            out = out.when(x <= edge, F.lit(i))
        return out.otherwise(F.lit(None).cast("int"))

    def apply(self, df: DataFrame, col: str, out: str = "bin") -> DataFrame:
        return df.withColumn(out, self.index(F.col(col).cast("double")))


def fixed_bands(cuts: Sequence[float]) -> Bands:
    return Bands(tuple(float(c) for c in cuts))


def band_ranges(df: DataFrame, col: str, bin_col: str = "bin") -> DataFrame:
    """Realised minimum and maximum of every band, keyed by band number."""
    return df.where(F.col(bin_col).isNotNull()).groupBy(bin_col).agg(
        F.min(col).alias("low"), F.max(col).alias("high"), F.count(F.lit(1)).alias("n"))


def equal_freq_bands(df: DataFrame, col: str, n: int, approximate: bool = False) -> Bands:
    """Quantile cuts by linear interpolation; repeated cuts are dropped."""
    probs = [i / n for i in range(n + 1)]
    if approximate:
        cuts = df.agg(F.percentile_approx(F.col(col).cast("double"), probs, F.lit(100_000))).first()[0] or []
    else:
        row = exact_quantiles(df, [col], probs).first()
        cuts = [row[f"q{i}"] for i in range(n + 1)] if row else []
    return Bands(tuple(sorted(set(cuts))), closed_start=True)


def equal_freq_bands_weighted(df: DataFrame, col: str, weight: str, n: int) -> Bands:
    """Rows in value order with their running weight: each cut is the value of the last row
    whose running weight is at most the i/n point of the running-weight column itself."""
    rows = df.where(F.col(col).isNotNull()).select(
        F.col(col).cast("double").alias("v"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w"))
    cells = rows.groupBy("v", "w").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("cw", F.col("w") * F.col("n"))
    cum = stage(running(cells, ["v", "w"], sums=["n", "cw"]), "weights")
    total = cum.agg(F.sum("n")).first()[0] or 0
    if not total:
        return Bands((-math.inf, math.inf))
    # running weight of the row with 0-based rank r, inside its run of equal (v, w) rows
    at = lambda r: (F.col("cum_cw") - F.col("cw") + F.col("w") * (
        F.lit(r) - (F.col("cum_n") - F.col("n")) + 1))
    holds = lambda r: ((F.col("cum_n") - F.col("n")) <= r) & (F.lit(r) < F.col("cum_n"))
    spots = [(total - 1) * i / n for i in range(1, n)]
    picks = cum.agg(*[F.max(F.when(holds(r), at(r))).alias(f"_{k}_{side}")
                      for k, s in enumerate(spots)
                      for side, r in (("lo", math.floor(s)), ("hi", math.ceil(s)))]).first()
    limits = []
    for k, s in enumerate(spots):
        lo, hi = picks[f"_{k}_lo"], picks[f"_{k}_hi"]
        limits.append(lo + (hi - lo) * (s - math.floor(s)))
    # a cell qualifies as soon as its first row does
    first_row = F.col("cum_cw") - F.col("cw") + F.col("w")
    row = cum.agg(*[F.max(F.when(first_row <= limit, F.col("v"))).alias(f"c{k}")
                    for k, limit in enumerate(limits)]).first() if limits else []
    cuts = sorted({c for c in row if c is not None})
    return Bands((-math.inf, *cuts, math.inf))


def equal_width_bands(df: DataFrame, col: str, n: int) -> Bands:
    """n equal bands over [min, max]; the first edge is lowered by 0.1 % of the range."""
    lo, hi = df.agg(F.min(F.col(col).cast("double")), F.max(F.col(col).cast("double"))).first()
    if lo is None:
        return Bands(())
    if lo == hi:
        pad = 0.001 * abs(lo) if lo else 0.001
        lo, hi = lo - pad, hi + pad
        edges = [lo + (hi - lo) * i / n for i in range(n + 1)]
    else:
        edges = [lo + (hi - lo) * i / n for i in range(n + 1)]
        edges[0] -= (hi - lo) * 0.001
    edges[-1] = hi
    return Bands(tuple(edges))


def _gini(weights: Sequence[float]) -> float:
    total = sum(weights)
    return 1.0 - sum((w / total) ** 2 for w in weights) if total else 1.0


def tree_totals(df: DataFrame, col: str, label: str, classes: Sequence,
                weight: str | None = None) -> DataFrame:
    """Distinct values with the running class weights and row counts, staged."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    names = [f"k{i}" for i in range(len(classes))]
    cells = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(F.when(F.col(label) == c, w).otherwise(0.0)).alias(k) for k, c in zip(names, classes)])
    return stage(running(cells, ["v"], sums=["rows", *names]), "tree")


def _gini_column(parts: Sequence[Column]) -> Column:
    total = sum(parts[1:], parts[0])
    squares = [(p / total) * (p / total) for p in parts]
    return F.lit(1.0) - sum(squares[1:], squares[0])


def tree_level(totals: DataFrame, nodes: Sequence[dict], k: int, min_leaf: float) -> dict:
    """The best cut of every open node in one aggregate over the distinct values.

    A node is a value interval (lo, hi] with the running totals before it (``before``) and
    its own totals (``own``). Returns node position -> (gain, value, totals up to it)."""
    v = F.col("v")
    which = F.lit(None).cast("int")
    for i, node in enumerate(nodes):
        inside = F.lit(True)
        if node["lo"] is not None:
            inside = inside & (v > node["lo"])
        if node["hi"] is not None:
            inside = inside & (v <= node["hi"])
        which = F.when(inside, F.lit(i)).otherwise(which)
    start = F.array(*[F.array(*[F.lit(float(x)) for x in n["before"]]) for n in nodes])
    own = F.array(*[F.array(*[F.lit(float(x)) for x in n["own"]]) for n in nodes])
    at = totals.withColumn("node", which).where("node is not null")
    at = at.select("node", "v", "cum_rows", *[f"cum_k{i}" for i in range(k)],
                   F.get(start, F.col("node")).alias("_b"), F.get(own, F.col("node")).alias("_o"))
    left = [F.col(f"cum_k{i}") - F.get("_b", F.lit(i)) for i in range(k)]
    right = [F.get("_o", F.lit(i)) - x for i, x in enumerate(left)]
    d1, d2 = sum(left[1:], left[0]), sum(right[1:], right[0])
    d = d1 + d2
    whole = _gini_column([a + b for a, b in zip(left, right)])
    gain = whole - (d1 / d * _gini_column(left) + d2 / d * _gini_column(right))
    ok = (d1 >= min_leaf) & (d2 >= min_leaf) & (d1 > 0) & (d2 > 0)
    scored = at.select("node", "v", "cum_rows", *[f"cum_k{i}" for i in range(k)],
                       F.when(ok, gain).alias("gain")).where("gain > 0")
    best = scored.groupBy("node").agg(F.max_by(
        F.struct("gain", "v", "cum_rows", *[f"cum_k{i}" for i in range(k)]),
        F.struct(F.col("gain"), (-v).alias("neg_v"))).alias("b"))
    return {r["node"]: (r["b"]["gain"], r["b"]["v"], r["b"]["cum_rows"],
                        [r["b"][f"cum_k{i}"] for i in range(k)]) for r in best.collect()}


def tree_bands(df: DataFrame, col: str, label: str, classes: Sequence, max_leaf: int = 5,
               min_percent: float = 0.05, weight: str | None = None) -> Bands:
    """Supervised Gini bands: split while a leaf keeps ``min_percent`` of all weight, then
    merge the neighbours that lose least until ``max_leaf`` bands (never below three).

    A cut lies half way to the next value. The table is reduced to distinct values once;
    each level of the tree is one aggregate over them, and the driver holds only the cuts
    (at most 1 / min_percent leaves)."""
    k = len(classes)
    totals = tree_totals(df, col, label, classes, weight)
    last = totals.agg(F.max("cum_rows"), *[F.max(f"cum_k{i}") for i in range(k)]).first()
    if last[0] is None:
        return Bands((-math.inf, math.inf))
    own = [float(x) for x in last[1:]]
    min_leaf = sum(own) * min_percent
    open_nodes = [{"lo": None, "hi": None, "before": [0.0] * k, "own": own, "first": 0, "rows": last[0]}]
    split_at: list[float] = []
    while open_nodes:
        found = tree_level(totals, open_nodes, k, min_leaf)
        children = []
        for i, (_, v, cum_rows, cum) in found.items():
            node = open_nodes[i]
            split_at.append(v)
            left = [c - b for c, b in zip(cum, node["before"])]
            rows_left = cum_rows - node["first"]
            small = {"lo": node["lo"], "hi": v, "before": node["before"], "own": left,
                     "first": node["first"], "rows": rows_left}
            large = {"lo": v, "hi": node["hi"], "before": list(cum),
                     "own": [o - x for o, x in zip(node["own"], left)],
                     "first": cum_rows, "rows": node["rows"] - rows_left}
            # the gate counts rows, the leaf minimum is a weight
            children += [n for n in (small, large) if n["rows"] >= min_leaf * 2]
        open_nodes = children
    if not split_at:
        return Bands((-math.inf, math.inf))
    split_at.sort()
    nexts = totals.agg(*[F.min(F.when(F.col("v") > s, F.col("v"))) for s in split_at]).first()
    at_cut = totals.where(F.col("v").isin(split_at)).collect()
    cum = {r["v"]: [r[f"cum_k{i}"] for i in range(k)] for r in at_cut}
    bounds = [[0.0] * k, *[cum[s] for s in split_at], own]
    leaves = [[b - a for a, b in zip(x, y)] for x, y in zip(bounds, bounds[1:])]
    cuts = [(s + n) / 2 for s, n in zip(split_at, nexts)]
    while len(leaves) > max_leaf and len(leaves) > 3:
        losses = []
        for a, b in zip(leaves, leaves[1:]):
            union = [x + y for x, y in zip(a, b)]
            share = sum(a) / sum(union)
            losses.append(share * _gini(a) + (1 - share) * _gini(b) - _gini(union))
        at = max(range(len(losses)), key=losses.__getitem__)
        leaves[at:at + 2] = [[x + y for x, y in zip(leaves[at], leaves[at + 1])]]
        del cuts[at]
    return Bands((-math.inf, *cuts, math.inf))


def bin_feature(df: DataFrame, col: str, method: str, miss_val: float = -1, dec: int = 2,
                cuts: Sequence[float] = (), n: int = 5, label: str | None = None,
                classes: Sequence = (0, 1), weight: str | None = None, max_leaf: int = 5,
                min_percent: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(rows with ``bin``, bands with their printed range).

    Null or ``miss_val`` rows form their own band, numbered ``miss_val``."""
    x = F.col(col).cast("double")
    present = df.where(x.isNotNull() & (x != miss_val))
    if method == "fixed":
        bands = fixed_bands(cuts)
    elif method == "equal_freq":
        bands = (equal_freq_bands_weighted(present, col, weight, n) if weight
                 else equal_freq_bands(present, col, n))
    elif method == "equal_width":
        bands = equal_width_bands(present, col, n)
    elif method == "tree" and label:
        bands = tree_bands(present, col, label, classes, max_leaf, min_percent, weight)
    else:
        raise ValueError(f"unknown method {method!r}, or its label is missing")
    miss = F.lit(int(miss_val))
    rows = df.withColumn("bin", F.when(x.isNull() | (x == miss_val), miss).otherwise(bands.index(x)))
    ranges = band_ranges(rows, col)
    if method in ("equal_freq", "equal_width") and not weight:
        edge = F.array(*[F.lit(e) for e in bands.edges]).cast("array<double>")
        low, high = F.get(edge, F.col("bin")), F.get(edge, F.col("bin") + 1)
        ranges = ranges.withColumns({"low": F.when(F.col("bin") == 0, F.col("low")).otherwise(low),
                                     "high": high})
    else:
        before = Window.partitionBy(F.col("bin") == miss).orderBy("bin")
        ranges = ranges.withColumn("low", F.coalesce(F.lag("high").over(before), F.col("low")))
    return rows, ranges.select("bin", "n", range_label(miss_val, dec).alias("bin_range"))


def range_label(miss_val: float, dec: int) -> Column:
    """``[a, b]`` for the first band, ``(a, b]`` for the others."""
    text = lambda c: F.round(F.col(c).cast("double"), dec).cast("string")
    missing = F.lit(f"[{miss_val}, {miss_val}]")
    opening = F.when(F.col("bin") == 0, F.lit("[")).otherwise(F.lit("("))
    return F.when(F.col("bin") == int(miss_val), missing).otherwise(
        F.concat(opening, text("low"), F.lit(", "), text("high"), F.lit("]")))


def quantile_cuts(df: DataFrame, ns: dict[str, int]) -> dict[str, Bands]:
    """Equal-frequency bands of several columns, each with its own number, in one plan."""
    probs = sorted({i / n for n in ns.values() for i in range(n + 1)})
    rows = {r["feature"]: r for r in exact_quantiles(df, list(ns), probs).collect()}
    out = {}
    for col, n in ns.items():
        row = rows.get(col)
        cuts = {row[f"q{probs.index(i / n)}"] for i in range(n + 1)} if row else set()
        out[col] = Bands(tuple(sorted(cuts)), closed_start=True)
    return out


def quantile_cut(df: DataFrame, ns: dict[str, int], suffix: str = "_quant") -> DataFrame:
    """At most n quantile buckets per column, fewer where values repeat, a single 0 where
    all are equal. ``df`` is staged: finding the cuts reads it many times, cutting once more."""
    df = stage(df, "quantiles")
    bands = quantile_cuts(df, ns)
    return df.withColumns({
        c + suffix: b.index(F.col(c).cast("double")) if len(b.edges) > 1
        else F.when(F.col(c).isNotNull(), F.lit(0)) for c, b in bands.items()})


def group_code(quants: Sequence[str], ns: Sequence[int]) -> Column:
    """Leading one, then each bucket in as many decimal digits as its size needs: a long, or
    the same digits as text where the declared sizes need more than 18 of them."""
    carry = []
    for n in ns:
        step, left = 1, float(n)
        while left > 1:
            left, step = left / 10, step * 10
        carry.append(step)
    if math.prod(carry) > 10 ** 17:
        digits = [F.lpad(F.col(q).cast("string"), len(str(step)) - 1, "0") for q, step in zip(quants, carry) if step > 1]
        return F.concat(F.lit("1"), *digits)
    code, place = F.lit(math.prod(carry)).cast("long"), 1
    for q, step in zip(reversed(list(quants)), reversed(carry)):
        code = code + F.col(q).cast("long") * F.lit(place)
        place *= step
    return code


def woe_iv(df: DataFrame, bin_col: str, label: str, weight: str | None = None,
           true_value=1, false_value=0, ranges: Sequence[str] | None = None) -> DataFrame:
    """good, bad, total, bad rate, WOE, IV and lift per band, and a total row.

    With ``ranges``, the text of every band by its number (see :func:`range_texts`), there is a
    ``bin_range`` column too; the total row spans from the first band's start to the last one's end.

    A band that lacks one of the classes has a null WOE and IV and is skipped in the total
    IV; only a true zero share gives 0. Lift compares bad rates."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    per = df.groupBy(F.col(bin_col).cast("string").alias("bin_index")).agg(
        F.sum(F.when(F.col(label) == true_value, w)).alias("good"),
        F.sum(F.when(F.col(label) == false_value, w)).alias("bad"))
    whole = Window.partitionBy(F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    per = per.withColumns({
        "total": zero("good") + zero("bad"),
        "_good": F.sum("good").over(whole), "_bad": F.sum("bad").over(whole)})
    pos, neg = F.try_divide("good", "_good"), F.try_divide("bad", "_bad")
    woe = (F.when(pos.isNull() | neg.isNull(), F.lit(None).cast("double"))
           .when((pos == 0) | (neg == 0), F.lit(0.0)).otherwise(F.ln(pos / neg)))
    per = per.withColumn("woe", woe).withColumn("iv", F.abs((pos - neg) * F.col("woe")))
    rate = F.try_divide("bad", "total")
    overall = F.try_divide(F.col("_bad"), F.col("_good") + F.col("_bad"))
    cols = ["bin_index", "good", "bad", "total", "bad_rate", "woe", "iv", "lift"]
    rows = per.withColumns({"bad_rate": F.round(rate * 100, 1),
                            "lift": F.round(F.try_divide(rate, overall), 2)}).select(*cols)
    total = per.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"),
                    F.sum("total").alias("total"), F.sum("iv").alias("iv"))
    total = total.select(
        F.lit("total").alias("bin_index"), "good", "bad", "total",
        F.round(rate * 100, 1).alias("bad_rate"), F.lit(-9999.0).alias("woe"), "iv",
        F.lit(-9999.0).alias("lift"))
    out = rows.unionByName(total)
    if ranges is None:
        return out
    texts = list(ranges)
    whole_range = f"{texts[0].split(',')[0]},{texts[-1].split(',')[1]}" if texts else None
    text = F.when(F.col("bin_index") == "total", F.lit(whole_range)).otherwise(
        F.get(F.array(*[F.lit(x) for x in texts]), F.expr("try_cast(bin_index AS int)")))
    return out.withColumn("bin_range", text)


def range_texts(bands: Bands) -> list[str]:
    """``(a, b]`` for every band, ``[a, b]`` for a first one with its start."""
    return [f"{'[' if i == 0 and bands.closed_start else '('}{a:g}, {b:g}]"
            for i, (a, b) in enumerate(zip(bands.edges[:-1], bands.edges[1:]))]
