"""Items for rows under quotas, by prices per bucket.

Every bucket is a market: row i of weight w takes one item j of value v[i, j], and the weights
of an item's rows stay within its quota c[j]. For any prices p >= 0 per unit of weight,

    sum_i max_j (v[i, j] - p[j] w[i]) + sum_j p[j] c[j]

is above the value of every allocation. The prices that make this bound least are found with the
maximum smoothed by a temperature: value, gradient and curvature of the smooth bound are sums over
the rows, so a step is one aggregate over them and a Newton step of a few numbers per bucket. A step
that does not lower the smooth bound is taken back and shortened, and the temperature falls
where a bucket is near its smooth optimum, until the shares of the items fit the quotas well enough.

Then every row takes its best item, and what is over quota moves where it costs least, by ranked
shifts between items (``running``). The distance to the bound is stated with the result; while it
is too large, prices and shifts are refined. Prices, quotas and plans are written tables with a row
per bucket; the driver sees counts of open buckets only.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerflow.operators.ordered import running
from offerflow.session import stage

#: The temperature falls by this factor where the shares miss the quotas by at most NEAR of the weight and the
#: step stays within its reach.
COOLING, NEAR = 3.0, 0.2
#: The first temperature is the spread of values per weight divided by this.
FIRST = 16.0
#: Longest price step, in temperatures.
REACH = 8.0
#: Lowest temperature, as a share of the spread of values per weight.
COLDEST = 1e-10

STATE = ("bucket long, n double, caps array<double>, prices array<double>, tau double, spread double, reach double, "
         "bound double, bound_prices array<double>, ref_tau double, ref_soft double, ref_prices array<double>, "
         "ref_shares array<double>, ref_cross array<double>, slackness double, cold boolean")


@dataclass(frozen=True)
class Allocation:
    """``frame``: key, bucket, item_idx. ``bound`` is above any allocation's value, ``gap`` the relative
    distance to it. ``excess`` is the weight above quota, 0 but where rows are too heavy to be exchanged."""

    frame: DataFrame
    value: float
    bound: float
    excess: float = 0.0

    @property
    def gap(self) -> float:
        return (self.bound - self.value) / max(abs(self.bound), 1e-12)


def next_prices(caps: np.ndarray, prices: np.ndarray, tau: float, shares: np.ndarray, cross: np.ndarray,
                n: float, reach: float) -> np.ndarray:
    """Newton step of the smooth bound within ``reach`` of ``prices``, prices not below 0.

    ``cross`` holds the sums of products of shares of two items; the curvature is their Laplacian
    over the temperature. The quadratic model is minimised coordinate by coordinate."""
    curve = -cross
    np.fill_diagonal(curve, 0.0)
    np.fill_diagonal(curve, -curve.sum(axis=1))
    curve = curve / tau
    curve[np.diag_indices(len(prices))] += 1e-9 * n / tau
    slope, low, high, out = caps - shares, np.maximum(0.0, prices - reach), prices + reach, prices.copy()
    for _ in range(200):
        before = out.copy()
        for j in range(len(out)):
            out[j] = min(max(out[j] - (slope[j] + curve[j] @ (out - prices)) / curve[j, j], low[j]), high[j])
        if np.abs(out - before).max() <= 1e-6 * tau:
            break
    return out


def _advanced(r: dict, target: float) -> dict:
    """The state of a bucket after its sums at the current prices are known."""
    caps, prices, tau, n = np.array(r["caps"]), np.array(r["prices"]), r["tau"], r["n"]
    m = len(caps)
    shares = np.array([r[f"g{j}"] for j in range(m)])
    cross = np.zeros((m, m))
    for j in range(m):
        for k in range(j):
            cross[j, k] = cross[k, j] = r[f"h{k}_{j}"]
    bound, soft = r["hard"] + prices @ caps, r["soft"] + prices @ caps
    out = {name: r[name] for name in ("bucket", "n", "caps", "tau", "spread", "reach")}
    better = bound < r["bound"]
    out["bound"], out["bound_prices"] = (bound, list(prices)) if better else (r["bound"], r["bound_prices"])
    over = np.maximum(shares - caps, 0).sum()
    # what the shares fall short of the bound, and what the weight above quota may cost to move
    short = abs(r["hard"] - r["mean"] + prices @ (caps - shares))
    out["slackness"] = (short + over * tau) / max(abs(out["bound"]), 1e-12)
    out["cold"] = tau <= r["spread"] * COLDEST
    ref = r["ref_tau"] == tau
    if ref and soft > r["ref_soft"] + 1e-12 * abs(soft):  # no better than the last point: a shorter step from there
        out["reach"] = r["reach"] / 4
        prices, shares, soft = np.array(r["ref_prices"]), np.array(r["ref_shares"]), r["ref_soft"]
        cross = np.array(r["ref_cross"]).reshape(m, m)
    else:
        out["reach"] = min(r["reach"] * 2, REACH)
    miss = caps - shares
    miss = np.abs(np.where(prices <= 0, np.minimum(miss, 0), miss)).sum()
    step = next_prices(caps, prices, tau, shares, cross, n, out["reach"] * tau)
    out.update(prices=list(step), ref_tau=tau, ref_soft=soft, ref_prices=list(prices), ref_shares=list(shares),
               ref_cross=list(cross.ravel()))
    inside = np.abs(step - prices).max() < 0.99 * out["reach"] * tau
    if (miss <= NEAR * n and inside) or out["reach"] < 1e-3:
        out.update(tau=max(tau / COOLING, r["spread"] * COLDEST), ref_tau=-1.0, reach=max(out["reach"], 1.0))
    return out


class Market:
    """Staged rows (bucket, key, w, s0 .. sm-1: values, null where the row may not have the item)
    and a state table with a row per bucket. ``unit``: all weights are 1."""

    def __init__(self, rows: DataFrame, key: str, m: int, caps: Callable[[Column], Column], unit: bool):
        self.rows, self.key, self.m, self.unit = rows, key, m, unit
        self.values = [f"s{j}" for j in range(m)]
        per = [F.col(s) / F.col("w") for s in self.values]
        highest = F.greatest(*per) if m > 1 else per[0]
        lowest = F.least(*per) if m > 1 else per[0]
        sizes = rows.groupBy("bucket").agg(
            F.sum("w").cast("double").alias("n"), F.max(highest).alias("hi"), F.min(lowest).alias("lo"),
            F.sum(F.when(highest.isNull(), F.col("w")).otherwise(0)).cast("double").alias("out"),
            F.max("w").cast("double").alias("heaviest"))
        spread = F.greatest(F.col("hi") - F.col("lo"), F.abs("hi") * 1e-9, F.lit(1e-12))
        zeros = F.array(*[F.lit(0.0)] * m)
        none = F.array().cast("array<double>")
        state = sizes.select(
            "bucket", "n", caps(F.col("n")).alias("caps"), zeros.alias("prices"), (spread / FIRST).alias("tau"),
            spread.alias("spread"), F.lit(REACH).alias("reach"), F.lit(float("inf")).alias("bound"),
            zeros.alias("bound_prices"), F.lit(-1.0).alias("ref_tau"), F.lit(0.0).alias("ref_soft"), none.alias("ref_prices"),
            none.alias("ref_shares"), none.alias("ref_cross"), F.lit(float("inf")).alias("slackness"), F.lit(False).alias("cold"),
            "out", "heaviest")
        self.state = stage(state, "market")
        room = F.aggregate("caps", F.lit(0.0), lambda a, x: a + x)
        lost = self.state.select("bucket", "n", "out", room.alias("room")).filter(
            (F.col("out") > 0) | (F.col("n") > F.col("room") * (1 + 1e-12))).first()
        if lost:
            raise ValueError(f"bucket {lost['bucket']}: " + (
                f"rows of weight {lost['out']} may not have any open item" if lost["out"] else
                f"weight {lost['n']} is more than all quotas, {lost['room']}"))

    # expressions are SQL texts: there are many of them in every pass, and texts are quick to build

    def _priced(self, prices: str, *more: str) -> DataFrame:
        """Rows next to the prices of their bucket, with the net value per weight of each item.
        The state is a written table with a row per bucket; its size decides how it is joined."""
        state = self.state.selectExpr("bucket", f"{prices} AS _p", "tau AS _tau")
        return self.rows.join(state, "bucket").selectExpr(
            *(more or ["*"]), "_tau", *[f"{s} / w - _p[{j}] AS _u{j}" for j, s in enumerate(self.values)])

    def _sums(self) -> DataFrame:
        every = range(self.m)
        nets = [f"_u{j}" for j in every]
        top = f"greatest({', '.join(nets)})" if self.m > 1 else nets[0]
        raised = self._priced("prices", "bucket", "w").selectExpr("*", f"{top} AS _top").selectExpr(
            "*", *[f"coalesce(exp((_u{j} - _top) / _tau), 0D) AS _e{j}" for j in every])
        share = raised.selectExpr("*", " + ".join(f"_e{j}" for j in every) + " AS _z").selectExpr(
            "bucket", "w", "_tau", "_top", "_z", *nets, *[f"_e{j} / _z AS _q{j}" for j in every])
        mean = " + ".join(f"coalesce(_q{j} * _u{j}, 0D)" for j in every)
        return share.groupBy("bucket").agg(*map(F.expr, [
            "sum(w * _top) AS hard", "sum(w * (_top + _tau * ln(_z))) AS soft", f"sum(w * ({mean})) AS mean",
            *[f"sum(w * _q{j}) AS g{j}" for j in every],
            *[f"sum(w * _q{j} * _q{k}) AS h{j}_{k}" for j in every for k in every if j < k]]))

    def price(self, target: float) -> None:
        """Steps until every bucket's shares are within ``target`` of its bound, or it is cold."""
        names = [f.split(" ")[0] for f in STATE.split(", ")]

        def advance(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield pd.DataFrame([_advanced(r, target) for r in part.to_dict("records")], columns=names)

        while True:
            known = self.state.select(*names).join(self._sums(), "bucket")
            self.state = stage(known.mapInPandas(advance, STATE), "market")
            if not self.state.filter((F.col("slackness") > target) & ~F.col("cold")).head(1):
                return

    def bound(self) -> float:
        return self.state.agg(F.sum("bound")).first()[0] or 0.0

    def best_items(self) -> DataFrame:
        """Every row with the item of its best net value at the prices of the best bound."""
        nets = ", ".join(f"named_struct('u', _u{j}, 'j', -{j})" for j in range(self.m))
        return self._priced("bound_prices").selectExpr(
            *self.rows.columns, f"CAST(-array_max(filter(array({nets}), x -> x.u IS NOT NULL)).j AS INT) AS choice")

    # --- shifts between items ---------------------------------------------------------------------

    def _held(self, cur: DataFrame) -> DataFrame:
        """Per bucket: quotas, prices, weight held per item, and weight of item j's rows that may have k,
        all of them and those that lose next to nothing by it (a few temperatures)."""
        every = range(self.m)
        state = self.state.selectExpr("bucket", "caps", "bound_prices AS _prices", f"tau * {2 * REACH} AS _near")
        priced = cur.join(state.drop("caps"), "bucket")
        per = priced.groupBy("bucket", "choice").agg(F.expr("CAST(sum(w) AS DOUBLE) AS w"), *[
            F.expr(f"CAST(sum(IF({s} IS NOT NULL, w, 0)) AS DOUBLE) AS r{k}") for k, s in enumerate(self.values)], *[
            F.expr(f"CAST(sum(IF({s} IS NOT NULL AND {self._loss(k)} <= _near, w, 0)) AS DOUBLE) AS c{k}")
            for k, s in enumerate(self.values)])
        lists = [f"array({', '.join(f'{x}{k}' for k in every)}) AS {x}" for x in "rc"]
        held = per.selectExpr("bucket", "choice", "w", *lists).groupBy("bucket").agg(
            *[F.expr(f"sum(IF(choice = {j}, w, 0D)) AS w{j}") for j in every],
            *[F.expr(f"max(IF(choice = {j}, {x}, NULL)) AS {x}{j}") for x in "rc" for j in every])
        none = f"array_repeat(0D, {self.m})"
        held = held.selectExpr("bucket", f"array({', '.join(f'w{j}' for j in every)}) AS held", *[
            f"array({', '.join(f'coalesce({x}{j}, {none})' for j in every)}) AS {y}" for x, y in (("r", "reach"), ("c", "cheap"))])
        return state.join(held, "bucket")

    def _shift(self, cur: DataFrame, plan: DataFrame, cost: Callable[[int], str], by: list[str]) -> DataFrame:
        """Rows go to the item of least ``cost`` among those with an amount that holds their weight, those of
        least cost per weight first, until amount and need are reached. ``plan``: bucket, choice,
        amounts (per item), need. Rows to move are told apart by the last (cost, key) of each group."""
        key = self.key
        df = cur.join(plan, ["bucket", "choice"], "left")
        options = ", ".join(f"named_struct('c', IF(amounts[{k}] >= w AND {s} IS NOT NULL, {cost(k)}, NULL), 'k', {k})"
                            for k, s in enumerate(self.values))
        df = df.selectExpr("*", f"array_min(filter(array({options}), x -> x.c IS NOT NULL)) AS _best").selectExpr(
            *cur.columns, "need", "_best.c AS _cost", "_best.k AS _to", "get(amounts, _best.k) AS _amount")
        ready = df.filter("_cost IS NOT NULL").selectExpr(
            "bucket", "choice", "_to", "_cost", f"`{key}` AS _key", "w", "need", "_amount")
        ranked = running(ready, ["_cost", "_key"], by, sums=["w"])
        fits = F.col("cum_w") <= F.col("_amount") * (1 + 1e-12)
        if not self.unit:
            ranked = running(ranked.withColumnRenamed("cum_w", "_cum"), ["_cost", "_key"], ["bucket", "choice"], sums=["w"], rank="_rn2")
            fits = (F.col("_cum") <= F.col("_amount") * (1 + 1e-12)) & (F.col("cum_w") - F.col("w") < F.col("need"))
        last = stage(ranked.filter(fits).groupBy(*by).agg(F.max(F.struct("_cost", "_key")).alias("_last")), "limits")
        goes = F.coalesce(F.struct(F.col("_cost"), F.col(key).alias("_key")) <= F.col("_last"), F.lit(False))
        return stage(df.join(last, by, "left").select(
            *[c for c in cur.columns if c != "choice"],
            F.when(F.col("_cost").isNotNull() & goes, F.col("_to")).otherwise(F.col("choice")).alias("choice")), "allocation")

    def _own(self) -> str:
        return f"get(array({', '.join(self.values)}), choice)"

    def _loss(self, k: int) -> str:
        """What a row loses per weight, at the prices, by going from its item to ``k``."""
        return f"{self._own()} / w - get(_prices, choice) - (s{k} / w - _prices[{k}])"

    def _gain(self, k: int) -> str:
        """Minus what a row's value rises per weight by going to ``k``, where it does."""
        return f"IF(choice <> {k} AND s{k} > {self._own()}, ({self._own()} - s{k}) / w, NULL)"

    def _planned(self, cur: DataFrame, planner: Callable) -> DataFrame:
        """The planner's rows (choice, amounts, need) of every bucket, as a written table."""
        def plan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                rows = []
                for r in part.itertuples():
                    here = Holding(np.array(r.caps), np.array(r.held), np.array([list(x) for x in r.reach]),
                                   np.array([list(x) for x in r.cheap]), np.array(r.prices), r.near)
                    rows += [(r.bucket, j, [float(x) for x in amounts], float(need), list(r.prices))
                             for j, amounts, need in planner(here)]
                yield pd.DataFrame(rows, columns=["bucket", "choice", "amounts", "need", "_prices"])

        held = self._held(cur).withColumnsRenamed({"_prices": "prices", "_near": "near"})
        return stage(held.mapInPandas(
            plan, "bucket long, choice int, amounts array<double>, need double, _prices array<double>"), "plan")

    def fit(self, cur: DataFrame) -> DataFrame:
        """Moves weight above quota to items with room until none is left, or none can be moved.

        Rows of weight 1 move along shortest chains of items, if possible where moves lose next to nothing;
        each round fills a place for every chain, so it ends, and a full item without any chain
        proves that there is no solution. Heavier rows move to items that
        hold them whole, then by exchanges that lower the excess."""
        planner = chains if self.unit else direct
        while True:
            plan = self._planned(cur, planner)
            planned = plan.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("choice") < 0, F.col("bucket"))).alias("stuck")).first()
            if planned["stuck"] is not None:
                raise ValueError(f"bucket {planned['stuck']}: the quotas cannot be met under the rules")
            if not planned["n"]:
                return cur
            moved = self._shift_by_loss(cur, plan)
            if moved is None:
                moved = None if self.unit else self._exchange(cur)
                if moved is None:
                    return cur
            cur = moved

    def _shift_by_loss(self, cur: DataFrame, plan: DataFrame) -> DataFrame | None:
        prices = self.state.select("bucket", F.col("bound_prices").alias("_prices"))
        with_prices = cur.join(prices, "bucket")
        out = self._shift(with_prices, plan.drop("_prices"), self._loss, ["bucket", "choice", "_to"]).drop("_prices")
        if not self.unit and not self._changed(cur, plan):
            return None
        return out

    def _changed(self, cur: DataFrame, plan: DataFrame) -> bool:
        """Whether any row fits one of the planned amounts."""
        fits = " OR ".join(f"(amounts[{k}] >= w AND {s} IS NOT NULL)" for k, s in enumerate(self.values))
        return bool(cur.join(plan, ["bucket", "choice"]).filter(fits).head(1))

    def _exchange(self, cur: DataFrame) -> DataFrame | None:
        """Swaps two rows per overfull item, the pair that lowers its excess most, then cheapest, or None.

        Only sizes matter: per (from, to, weight) the cheapest row is kept, and the sizes of one
        item meet those of the other in order, so no pairs of rows are formed."""
        key = self.key
        held = self._held(cur).select("bucket", "caps", "held", "_prices")
        rows = cur.join(held, "bucket").select(*cur.columns, "_prices", "caps", "held")
        ways = ", ".join(f"named_struct('to', {k}, 'loss', IF({s} IS NOT NULL AND choice <> {k}, ({self._loss(k)}) * w, NULL))"
                         for k, s in enumerate(self.values))
        sizes = rows.selectExpr("bucket", "choice", "w", f"`{key}`", "caps", "held", f"inline(array({ways}))").filter("loss IS NOT NULL").groupBy(
            "bucket", "choice", "to", "w").agg(
            F.min(F.struct("loss", F.col(key).alias("key"))).alias("best"), F.first("caps").alias("caps"), F.first("held").alias("held"))
        sizes = sizes.select("bucket", F.least("choice", "to").alias("a"), F.greatest("choice", "to").alias("b"), "choice", "to",
                             F.col("w").cast("double").alias("w"), "best.loss", "best.key",
                             (F.get("held", F.col("choice")) - F.get("caps", F.col("choice"))).alias("over"),
                             (F.get("caps", F.col("to")) - F.get("held", F.col("to"))).alias("room"))
        kind = dict(cur.dtypes)[key]
        found = stage(sizes.groupBy("bucket", "a", "b").applyInPandas(
            best_swap, f"bucket long, choice int, to int, key {kind}, other {kind}, lowers double, loss double"), "swaps")
        one = found.groupBy("bucket").agg(F.max_by(F.struct("choice", "to", "key", "other"), F.struct(
            "lowers", -F.col("loss"))).alias("s")).select("bucket", "s.*")
        moves = stage(one.select("bucket", F.col("key").alias(key), F.col("to").alias("_new")).union(
            one.select("bucket", F.col("other").alias(key), F.col("choice").alias("_new"))), "swaps")
        if not moves.head(1):
            return None
        return stage(cur.join(moves, ["bucket", key], "left").withColumn("choice", F.coalesce("_new", "choice")).drop("_new").select(
            *cur.columns), "allocation")

    def fill(self, cur: DataFrame) -> DataFrame | None:
        """Fills room that is worth more than where its rows are now; None if there is none.

        Rows of weight 1 move along chains that lose next to nothing from an item of lower price to
        one of higher price with room; heavier ones go straight to room, the greatest rise first."""
        if self.unit:
            plan = self._planned(cur, priced_chains)
            return self._shift_by_loss(cur, plan) if plan.head(1) else None
        plan = self._planned(cur, rooms)
        gains = " OR ".join(f"(amounts[{k}] >= w AND {self._gain(k)} IS NOT NULL)" for k in range(self.m))
        if not cur.join(plan, ["bucket", "choice"]).filter(gains).head(1):
            return None
        return self._shift(cur, plan.drop("_prices"), self._gain, ["bucket", "_to"])

    def totals(self, cur: DataFrame) -> tuple[float, float]:
        """(value, weight above quota)."""
        held = cur.groupBy("bucket", "choice").agg(F.sum("w").alias("w"), F.expr(f"sum({self._own()}) AS v")).join(
            self.state.select("bucket", "caps"), "bucket")
        over = "w - get(caps, choice)"
        row = held.agg(F.sum("v"), F.expr(f"sum(IF({over} > w * 1e-12, {over}, 0D))")).first()
        return row[0] or 0.0, row[1] or 0.0

    def solve(self, target: float) -> Allocation:
        """An allocation within ``target`` of the bound, or the best one when the prices are exact."""
        best: tuple[float, float, DataFrame] | None = None
        aim = target
        while True:
            self.price(aim)
            cur = self.fit(stage(self.best_items(), "allocation"))
            value, excess = self.totals(cur)
            bound = self.bound()
            scale = max(abs(bound), 1e-12)
            while excess == 0 and bound - value > target * scale:
                more = self.fill(cur)
                if more is None:
                    break
                now, excess = self.totals(more)
                if now <= value:
                    break
                cur, value = more, now
            if best is None or (excess, -value) < (best[0], -best[1]):
                best = excess, value, cur
            # how far the prices can still lower the bound; what else is open lies in rows that cannot be split
            left = self.state.agg(F.sum(F.when(~F.col("cold"), F.col("slackness") * F.abs("bound")).otherwise(0.0))).first()[0]
            exact = left == 0 or (not self.unit and left <= 0.1 * (bound - best[1]))
            if (best[0] == 0 and bound - best[1] <= target * scale) or exact or aim <= 1e-9:
                frame = best[2].select(self.key, "bucket", F.col("choice").alias("item_idx"))
                return Allocation(frame, best[1], bound, best[0])
            aim /= 30


# --- plans of one bucket --------------------------------------------------------------------------

@dataclass(frozen=True)
class Holding:
    """What a bucket's items hold: quotas, weights, weight of j's rows that may have k (``reach``), that lose at
    most ``near`` per weight by it (``cheap``), and prices."""

    caps: np.ndarray
    held: np.ndarray
    reach: np.ndarray
    cheap: np.ndarray
    prices: np.ndarray
    near: float

    @property
    def over(self) -> np.ndarray:
        return np.maximum(self.held - self.caps, 0.0)

    @property
    def room(self) -> np.ndarray:
        return np.maximum(self.caps - self.held, 0.0)


Plan = list[tuple[int, np.ndarray, float]]


def steps_away(ends: np.ndarray, arcs: np.ndarray) -> np.ndarray:
    """Steps along arcs from each item to the nearest end, -1 if there is no way."""
    away = np.where(ends, 0, -1)
    todo = deque(np.flatnonzero(ends))
    while todo:
        k = todo.popleft()
        for j in np.flatnonzero((arcs[:, k] > 0) & (away < 0)):
            away[j] = away[k] + 1
            todo.append(j)
    return away


def chains(here: Holding) -> Plan:
    """Amounts to move along the shortest chains from overfull items to items with room: per item, an
    amount per other item. An item that no chain leaves gives a plan with choice -1."""
    m, over, room = len(here.caps), here.over, here.room
    if not over.any():
        return []
    for arcs in (here.cheap, here.reach):
        away = steps_away(room > 0, arcs)
        if (away[over > 0] >= 0).all():
            break
    else:
        return [(-1, np.zeros(m), 0.0)]
    amounts = np.zeros((m, m))

    def push(j: int, n: float) -> float:
        """Sends up to n from j on towards room; what was sent."""
        if away[j] == 0:
            sent = min(n, room[j])
            room[j] -= sent
            return sent
        total = 0.0
        for k in range(m):
            if away[k] == away[j] - 1 and k != j:
                sent = push(k, min(n - total, arcs[j, k] - amounts[j, k]))
                amounts[j, k] += sent
                total += sent
        return total

    for j in np.flatnonzero(over > 0):
        push(j, over[j])
    return [(int(j), amounts[j], float(amounts[j].sum())) for j in range(m) if amounts[j].any()]


def priced_chains(here: Holding) -> Plan:
    """The chain of cheap moves that ends in the dearest room it can fill from the cheapest item."""
    m, room = len(here.caps), here.room
    for end in sorted(np.flatnonzero(room > 0), key=lambda k: -here.prices[k]):
        away = steps_away(np.arange(m) == end, here.cheap)
        # each step may lose up to ``near``
        worth = [j for j in range(m) if away[j] > 0 and here.held[j] > 0
                 and here.prices[end] - here.prices[j] > here.near * away[j]]
        if not worth:
            continue
        j = min(worth, key=lambda x: (here.prices[x], away[x]))
        way = [j]
        while way[-1] != end:
            way.append(next(k for k in range(m) if away[k] == away[way[-1]] - 1 and here.cheap[way[-1], k] > 0))
        n = min(room[end], *[here.cheap[a, b] for a, b in zip(way, way[1:])])
        return [(int(a), np.where(np.arange(m) == b, n, 0.0), float(n)) for a, b in zip(way, way[1:])]
    return []


def direct(here: Holding) -> Plan:
    """The most overfull item may fill all room there is, until it is no longer overfull."""
    over = here.held - here.caps
    j = int(over.argmax())
    return [(j, here.room, float(over[j]))] if over[j] > 1e-9 * max(1.0, here.held[j]) else []


def rooms(here: Holding) -> Plan:
    """All room is open to every item's rows."""
    return [(j, here.room, float("inf")) for j in range(len(here.caps))] if here.room.any() else []


def best_swap(sizes: pd.DataFrame) -> pd.DataFrame:
    """For two items, one of them overfull: the heavier row to send and the lighter one to take back.

    Sizes in order; for every size sent, the sizes that may come back are a stretch, and the one that
    leaves most behind without overfilling is its first, the cheapest of equals."""
    names = ["bucket", "choice", "to", "key", "other", "lowers", "loss"]
    out = []
    for j in sizes["choice"].unique():
        mine, others = sizes[sizes["choice"] == j], sizes[sizes["choice"] != j].sort_values("w")
        if not len(others) or mine["over"].iloc[0] <= 0 or mine["room"].iloc[0] <= 0:
            continue
        over, room, back = mine["over"].iloc[0], mine["room"].iloc[0], others["w"].to_numpy()
        for r in mine.itertuples():
            most = min(over, room)
            # lightest return that keeps the difference within the room; past the excess, the nearest to it
            low = int(np.searchsorted(back, r.w - room - 1e-9))
            high = int(np.searchsorted(back, r.w - most - 1e-9))
            for i in {low, high} & set(range(len(back))):
                lowers = r.w - back[i]
                if lowers <= 1e-9 or lowers > room + 1e-9:
                    continue
                o = others.iloc[i]
                out.append((r.bucket, int(j), int(r.to), r.key, o["key"], float(min(lowers, over)), float(r.loss + o["loss"])))
    found = pd.DataFrame(out, columns=names)
    if not len(found):
        return found
    return found.sort_values(["lowers", "loss"], ascending=[False, True]).head(1)
