"""Budgeted choice: exactly one (value, weight) choice per class under one total weight.

The frames are long: ``class_id, choice, value, weight``. Each class is first reduced to
its efficient frontier, whose steps (extra value per extra weight) fall in efficiency. The
budget then amounts to one price: all steps above it are taken. The price is found by
narrowing a histogram of step efficiencies, a few aggregates whatever the number of
classes; only steps exactly at the price are put in order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from offerflow.operators.ordered import running
from offerflow.session import stage

#: Choices of one group, at most; slopes that a larger class is split at.
CLASS_CHUNK = 50_000
SPLITS = 32
BUCKETS = 1024
COLS = ["class_id", "choice", "value", "weight"]


def undominated(df: DataFrame) -> DataFrame:
    """Choices for which no other choice weighs at most as much and is worth at least as
    much. Works in chunks, so a class may be of any size."""
    ranked = running(df.select(*COLS), ["weight", "-value", "choice"], ["class_id"], maxes=["value"])
    return ranked.where(F.col("prev_max_value").isNull()
                        | (F.col("value") > F.col("prev_max_value"))).select(*COLS)


POINT = ["class_id", "part", "weight", "value", "choice"]


def push(hull: list[tuple], point: tuple) -> None:
    """Adds a point (weight, value, choice) to the upper concave hull of lighter ones, or of one as heavy
    and worth as much; vertices that fall under the new edge go."""
    w, v, _ = point
    if hull and v <= hull[-1][1]:
        return
    while len(hull) > 1:
        (wa, va, _), (wb, vb, _) = hull[-2], hull[-1]
        if (vb - va) * (w - wb) > (v - vb) * (wb - wa):
            break
        hull.pop()
    hull.append(point)


def _hulls_of(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The hull of every group's points, each with the slope of the edge that leaves it.

    Groups lie sorted in their partitions; the points of one pass by its stack of vertices, whatever
    batch they are in, so small groups cost little and no group is held but for its hull."""
    shape = StructType([rows.schema[c] for c in POINT]).add("slope", "double")
    arrow = to_arrow_schema(shape)
    by = list(by)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, owner, hull, out = None, None, [], []

        def close() -> None:
            for k, (w, v, c) in enumerate(hull):
                slope = (hull[k + 1][1] - v) / (hull[k + 1][0] - w) if k + 1 < len(hull) else None
                out.append((*owner, w, v, c, slope))

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*by, *POINT]]
            for row in zip(*columns):
                group, point = row[:len(by)], row[len(by):]
                if group != now:
                    close()
                    now, owner, hull = group, point[:2], []
                if not hull or point[2] > hull[-1][0]:  # one point per weight: the first is worth most
                    push(hull, point[2:])
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    placed = rows.repartition(*by).sortWithinPartitions(*by, "weight", F.col("value").desc(), "choice")
    return placed.mapInArrow(walk, shape)


def frontier_table(df: DataFrame, chunk: int = CLASS_CHUNK) -> DataFrame:
    """The frontiers as a written table of rows: class_id, step, choice, value, weight, and dw, dv, eff of the move
    that leads to each (null for step 0).

    Classes of up to ``chunk`` choices are folded in one pass each. A larger one is folded in chunks of
    neighbouring weights, and if more than ``chunk`` choices are left it is split: for some slopes the best
    choice is a vertex of the whole hull for certain; between two such vertices, what lies under their
    edge is dropped, and the rest is a smaller class of its own. So a class of any size spreads over many
    groups of bounded size, also if all of it is frontier."""
    points = df.select("class_id", F.lit(0).cast("long").alias("part"), F.col("weight").cast("double").alias("weight"),
                       F.col("value").cast("double").alias("value"), F.col("choice").cast("int").alias("choice"))
    done: list[DataFrame] = []
    left = stage(points, "points")
    while True:
        sizes = stage(left.groupBy("class_id", "part").agg(F.count(F.lit(1)).alias("_n")), "class-sizes")
        large = sizes.agg(F.max("_n")).first()[0] or 0
        if large <= chunk:
            done.append(_hulls_of(left, ["class_id", "part"]))
            break
        on = [F.col("class_id").eqNullSafe(F.col("_c")), F.col("part") == F.col("_p")]
        few = sizes.where(F.col("_n") <= chunk).select(F.col("class_id").alias("_c"), F.col("part").alias("_p"))
        done.append(_hulls_of(left.join(few, on, "left_semi"), ["class_id", "part"]))
        ranked = running(left.join(few, on, "left_anti"), ["weight", "-value", "choice"], ["class_id", "part"])
        pieces = ranked.withColumn("_chunk", F.floor((F.col("rn") - 1) / chunk)).select(*POINT, "_chunk")
        folded = stage(_hulls_of(pieces, ["class_id", "part", "_chunk"]), "hulls")
        sure, left = _split(folded, chunk)
        done.append(sure)
    rows = reduce(DataFrame.union, [d.select("class_id", "weight", "value", "choice") for d in done])
    if len(done) > 1:  # vertices that two parts share
        rows = rows.groupBy("class_id", "weight").agg(F.max("value").alias("value"), F.min("choice").alias("choice"))
    rows = rows.select("class_id", "weight", "value", "choice")
    if len(done) == 1:
        order = Window.partitionBy("class_id").orderBy("weight")  # at most ``chunk`` rows
        numbered = rows.withColumn("rn", F.row_number().over(order)).withColumns({
            "_w": F.lag("weight").over(order), "_v": F.lag("value").over(order)})
        return stage(_moves(numbered), "frontier")
    before = running(rows, ["weight"], ["class_id"], maxes=["weight", "value"])
    return stage(_moves(before.withColumnsRenamed({"prev_max_weight": "_w", "prev_max_value": "_v"})), "frontier")


def _moves(numbered: DataFrame) -> DataFrame:
    dw, dv = F.col("weight") - F.col("_w"), F.col("value") - F.col("_v")
    return numbered.select("class_id", (F.col("rn") - 1).cast("int").alias("step"), "choice", "value", "weight",
                           dw.alias("dw"), dv.alias("dv"), (dv / dw).alias("eff"))


def _split(folded: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(vertices that are certain, points that remain, in smaller parts) of classes in chunk hulls.

    Parts that their chunk hulls have brought down to ``chunk`` points stay whole. The others get their
    corners: both ends, and the best point at each of some slopes of their edges, among them that from end to end."""
    on = ["class_id", "part"]
    point = F.struct("weight", "value", "choice")
    ends = folded.groupBy(*on).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("slope", [i / SPLITS for i in range(1, SPLITS)]).alias("_s"),
        F.min_by(point, F.struct("weight", -F.col("value"), "choice")).alias("_a"),
        F.min_by(point, F.struct(-F.col("value"), "weight", "choice")).alias("_b"))
    across = F.try_divide(F.col("_b.value") - F.col("_a.value"), F.col("_b.weight") - F.col("_a.weight"))
    slopes = F.array_distinct(F.filter(F.concat("_s", F.array(across)), lambda x: x.isNotNull()))
    plan = stage(ends.select(F.col("class_id").alias("_c"), F.col("part").alias("_p"), "_n", slopes.alias("_slopes"), "_a", "_b"), "hull-ends")
    mine = [F.col("class_id").eqNullSafe(F.col("_c")), F.col("part") == F.col("_p")]
    rows = folded.join(plan, mine)
    whole = rows.where(F.col("_n") <= chunk).select(*POINT)
    large = rows.where(F.col("_n") > chunk)
    best = large.select(*on, point.alias("v"), F.explode("_slopes").alias("s")).groupBy(*on, "s").agg(
        F.max_by("v", F.struct(F.col("v.value") - F.col("s") * F.col("v.weight"), -F.col("v.weight"))).alias("v"))
    found = best.groupBy(*on).agg(F.collect_set("v").alias("_v")).join(plan, mine)
    corners = stage(found.select("_c", "_p", F.array_sort(F.array_distinct(F.concat("_v", F.array("_a", "_b")))).alias("_v")), "corners")
    cut = folded.join(corners, mine).withColumn("_i", F.size(F.filter("_v", lambda v: v["weight"] < F.col("weight")))).withColumns({
        "_l": F.get("_v", F.col("_i") - 1), "_r": F.get("_v", F.col("_i"))})
    # strictly between two corners and above the edge between them
    over = ((F.col("value") - F.col("_l.value")) * (F.col("_r.weight") - F.col("_l.weight"))
            > (F.col("_r.value") - F.col("_l.value")) * (F.col("weight") - F.col("_l.weight")))
    inside = stage(cut.where((F.col("weight") < F.col("_r.weight")) & over).select(
        "class_id", (F.col("part") * (SPLITS + 2) + F.col("_i")).alias("part"), "weight", "value", "choice", "_l", "_r"), "inside")
    edges = inside.groupBy(*on).agg(F.first("_l").alias("_l"), F.first("_r").alias("_r")).select(
        *on, F.inline(F.array("_l", "_r")))  # a part's two corners are the same for all its points
    sure = corners.select(F.col("_c").alias("class_id"), F.inline("_v"))
    return sure, stage(whole.unionByName(inside.select(*POINT)).unionByName(edges.select(*POINT)), "points")


def efficient_frontier(df: DataFrame, chunk: int = CLASS_CHUNK) -> DataFrame:
    """Undominated choices that no mix of two others beats, numbered by ``step`` from 0."""
    return frontier_table(df, chunk).select("class_id", "step", "choice", "value", "weight")


@dataclass(frozen=True)
class Price:
    """``alpha``: value per weight; ``used``: weight of the lightest choices and all moves
    better than ``alpha``; ``exhausted``: False when the budget takes every move."""

    alpha: float
    used: float
    exhausted: bool


def find_price(frontier: DataFrame, budget: float) -> Price:
    """The efficiency at which the moves stop fitting, exactly, by narrowing a histogram."""
    base = frontier.where("step = 0").agg(F.sum("weight")).first()[0] or 0.0
    slack = 1e-9 * max(1.0, abs(budget))
    if base > budget + slack:
        raise ValueError(f"budget {budget} is below the lightest allocation {base}")
    steps = frontier.where("step > 0")
    low, high, total = steps.agg(F.min("eff"), F.max("eff"), F.sum("dw")).first()
    used = base
    if low is None or used + total <= budget + slack:
        return Price(0.0, used + (total or 0.0), False)
    while low < high:
        width = (high - low) / BUCKETS
        at = F.least(F.floor((F.col("eff") - low) / width), F.lit(BUCKETS - 1))
        cells = (steps.where(F.col("eff").between(low, high)).groupBy(at.alias("b"))
                 .agg(F.sum("dw").alias("dw"), F.min("eff").alias("lo"), F.max("eff").alias("hi"))
                 .orderBy(F.col("b").desc()).collect())
        for cell in cells:
            if used + cell["dw"] > budget + slack:
                low, high = cell["lo"], cell["hi"]
                break
            used += cell["dw"]
        else:  # rounding only: everything in the interval fits after all
            low = high = cells[-1]["lo"]
            used -= cells[-1]["dw"]
    return Price(low, used, True)


def _last(rows: DataFrame) -> DataFrame:
    """Per class the row of the highest step."""
    return rows.groupBy("class_id").agg(F.max_by(F.struct("choice", "value", "weight"), "step").alias("_l")).select("class_id", "_l.*")


def _better(frontier: DataFrame, alpha: float) -> DataFrame:
    """The lightest choices and all moves that beat the price."""
    return frontier.where((F.col("step") == 0) | (F.col("eff") > alpha))


def knapsack_price(df: DataFrame, budget: float) -> tuple[Price, DataFrame, float]:
    """(price, allocation, upper bound). Every class takes the choice that is best at the
    price, the lighter one on ties, so the allocation stays within the budget."""
    frontier = frontier_table(df)
    price = find_price(frontier, budget)
    chosen = _last(_better(frontier, price.alpha if price.exhausted else -math.inf))
    gain = chosen.agg(F.sum(F.col("value") - price.alpha * F.col("weight"))).first()[0] or 0.0
    return price, chosen, price.alpha * budget + gain


def _filled(df: DataFrame, budget: float) -> tuple[DataFrame, DataFrame | None, float]:
    """The frontier's rows above the price, and the moves exactly at the price with their running
    weight against what is left."""
    frontier = frontier_table(df)
    price = find_price(frontier, budget)
    if not price.exhausted:
        return frontier, None, 0.0
    ties = running(frontier.where(F.col("eff") == price.alpha), ["class_id", "step"], sums=["dw"])
    return _better(frontier, price.alpha), ties, budget - price.used


def knapsack_integer(df: DataFrame, budget: float) -> DataFrame:
    """Moves in order of efficiency (ties by class and step) until the first that does not
    fit; one whole choice per class."""
    rows, ties, left = _filled(df, budget)
    if ties is not None:
        slack = 1e-9 * max(1.0, abs(budget))
        rows = rows.unionByName(ties.where(F.col("cum_dw") <= left + slack).select(*rows.columns))
    return _last(rows)


def knapsack_greedy(df: DataFrame, budget: float) -> DataFrame:
    """The same with the first move that does not fit taken in part: that class appears
    twice, and ``proportion`` tells how much of each choice it takes."""
    rows, ties, left = _filled(df, budget)
    if ties is None:
        return _last(rows).withColumn("proportion", F.lit(1.0))
    slack = 1e-9 * max(1.0, abs(budget))
    fits = F.col("cum_dw") <= left + slack
    kept = _last(rows.unionByName(ties.where(fits).select(*rows.columns)))
    start = F.col("cum_dw") - F.col("dw")
    # one move at most begins within what is left and ends beyond it
    part = ties.where(~fits & (start < left - slack)).select(
        "class_id", "choice", "value", "weight", ((F.lit(left) - start) / F.col("dw")).alias("proportion"))
    one = part.select(F.col("class_id").alias("_c"), F.col("proportion").alias("_f"))
    kept = kept.join(F.broadcast(one), F.col("class_id").eqNullSafe(F.col("_c")), "left")
    return kept.select("class_id", "choice", "value", "weight", (F.lit(1.0) - F.coalesce("_f", F.lit(0.0))).alias("proportion")).unionByName(part)


def coupon_groups(users: DataFrame, keys: Sequence[str], scores: Mapping[float, str]) -> DataFrame:
    """Users folded into groups: head count and the score sum of each amount."""
    return users.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_users"),
        *[F.sum(c).alias(f"value_{i}") for i, c in enumerate(scores.values())])


def coupon_budget(users: DataFrame, keys: Sequence[str], tier: str, scores: Mapping[float, str],
                  allowed: Mapping[int, Sequence[float]], average_cost: float) -> DataFrame:
    """One amount per group, total value as high as the budget ``average_cost`` per head
    allows; a group may only get the amounts of its tier."""
    groups = stage(coupon_groups(users, keys, scores), "groups")
    amounts = list(scores)
    may = F.lit(False)
    choices = []
    for i, a in enumerate(amounts):
        may = F.col(tier).isin([t for t, ok in allowed.items() if a in ok])
        choices.append(F.when(may, F.struct(
            F.lit(i).alias("choice"), F.round(f"value_{i}", 9).alias("value"),
            (F.col("n_users") * F.lit(float(a))).alias("weight"))))
    offers = groups.select(F.struct(*keys).alias("class_id"), F.inline(
        F.filter(F.array(*choices), lambda c: c.isNotNull())))
    people = groups.agg(F.sum("n_users")).first()[0] or 0
    chosen = knapsack_integer(offers, average_cost * people)
    table = F.array(*[F.lit(float(a)) for a in amounts])
    out = chosen.select("class_id.*", F.get(table, F.col("choice")).alias("coupon"), "value", "weight")
    return out.join(groups.select(*keys, "n_users"), list(keys))


def budget_report(groups: DataFrame, allocation: DataFrame, keys: Sequence[str], tier: str,
                  scores: Mapping[float, str], allowed: Mapping[int, Sequence[float]]) -> DataFrame:
    """Spent amount, mean cost, tier violations and value of the allocation, and its gain
    over giving everybody the same amount (one row per uniform policy)."""
    ok = F.lit(False)
    for t, amounts in allowed.items():
        ok = ok | ((F.col(tier) == t) & F.col("coupon").isin([float(a) for a in amounts]))
    own = allocation.agg(
        F.sum(F.col("coupon") * F.col("n_users")).alias("spent"), F.sum("n_users").alias("people"),
        F.sum("value").alias("value"), F.sum(F.when(ok, 0).otherwise(1)).alias("violations")).first()
    flat = groups.agg(*[F.sum(f"value_{i}").alias(f"v{i}") for i in range(len(scores))])
    rows = [F.struct(F.lit("allocation").alias("policy"), F.lit(own["value"]).alias("value"),
                     F.lit(own["spent"] / own["people"]).alias("mean_cost"),
                     F.lit(own["violations"]).cast("long").alias("violations"),
                     F.lit(0.0).alias("gain"))]
    rows += [F.struct(F.lit(f"uniform {a}").alias("policy"), F.col(f"v{i}").alias("value"),
                      F.lit(float(a)).alias("mean_cost"), F.lit(0).cast("long").alias("violations"),
                      ((F.lit(own["value"]) - F.col(f"v{i}")) / F.col(f"v{i}")).alias("gain"))
             for i, a in enumerate(scores)]
    return flat.select(F.inline(F.array(*rows)))
