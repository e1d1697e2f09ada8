import itertools
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from offerflow.operators import market, quotas


def users(spark, n, m, seed, ties=False):
    rng = random.Random(seed)
    rows = []
    for u in range(n):
        scores = [rng.choice([0.1, 0.5, 0.9]) if ties else rng.random() for _ in range(m)]
        rules = [rng.choice([1, 1, 1, 0, None]) for _ in range(m)]
        rows.append((u, *scores, *rules))
    names = ", ".join([f"s{i} double" for i in range(m)] + [f"r{i} int" for i in range(m)])
    return rows, spark.createDataFrame(rows, f"uid long, {names}")


def best_by_force(rows, m, caps):
    best = None
    for pick in itertools.product(range(m), repeat=len(rows)):
        if any(rows[k][1 + m + j] == 0 for k, j in enumerate(pick)):
            continue
        if any(n > caps[j] for j, n in Counter(pick).items()):
            continue
        value = sum(rows[k][1 + j] for k, j in enumerate(pick))
        best = value if best is None else max(best, value)
    return best


def caps_of(ratios):
    return lambda n: F.array(*[F.ceil(n * r).cast("double") for r in ratios])


def test_tiny_markets_are_optimal(spark):
    """Many small instances as buckets of one market, each against brute force."""
    m, ratios, n = 3, [0.5, 0.4, 0.3], 7
    caps = [math.ceil(n * r) for r in ratios]
    rows, want = [], {}
    for b in range(10):
        rng, ties = random.Random(b), b % 2
        part = [(b * 100 + u, *[rng.choice([0.1, 0.5, 0.9]) if ties else rng.random() for _ in range(m)],
                 *[rng.choice([1, 1, 1, 0, None]) for _ in range(m)]) for u in range(n)]
        best = best_by_force(part, m, caps)
        if best is not None:
            want[b] = best
            rows += [(b, r[0], 1.0, *[None if r[1 + m + j] == 0 else r[1 + j] for j in range(m)]) for r in part]
    df = spark.createDataFrame(rows, "bucket long, uid long, w double, s0 double, s1 double, s2 double")
    out = market.Market(df, "uid", m, caps_of(ratios), unit=True).solve(1e-4)
    values = {r[1]: r[3:] for r in rows}
    got, held = Counter(), Counter()
    for r in out.frame.collect():
        got[r["bucket"]] += values[r["uid"]][r["item_idx"]]
        held[r["bucket"], r["item_idx"]] += 1
    assert all(k <= caps[j] for (_, j), k in held.items()) and sum(held.values()) == len(rows)
    assert len(want) > 6 and all(got[b] == pytest.approx(want[b], abs=5e-3) for b in want)
    assert out.bound >= sum(want.values()) - 1e-6 >= out.value - 2e-6 and out.gap <= 1e-4 and out.excess == 0


def test_tiny_weighted_markets(spark):
    """Rows of unequal weight: never above the optimum, the bound never below, quotas kept where they can be."""
    rows, want, ratios = [], {}, [0.5, 0.45, 0.4]
    for b in range(8):
        rng = random.Random(b)
        weights = [rng.randint(1, 6) for _ in range(7)]
        values = [[rng.random() * w for _ in range(3)] for w in weights]
        best = groups_by_force(weights, values, [math.ceil(sum(weights) * r) for r in ratios])
        if best is not None:
            want[b] = best
            rows += [(b, b * 100 + i, float(w), *v) for i, (w, v) in enumerate(zip(weights, values))]
    df = spark.createDataFrame(rows, "bucket long, uid long, w double, s0 double, s1 double, s2 double")
    out = market.Market(df, "uid", 3, caps_of(ratios), unit=False).solve(1e-4)
    by = {r[1]: r for r in rows}
    got, held, size = Counter(), Counter(), Counter()
    for r in out.frame.collect():
        row = by[r["uid"]]
        got[r["bucket"]] += row[3 + r["item_idx"]]
        held[r["bucket"], r["item_idx"]] += row[2]
        size[r["bucket"]] += row[2]
    over = sum(max(0, h - math.ceil(size[b] * ratios[j])) for (b, j), h in held.items())
    assert over == pytest.approx(out.excess) and len(want) > 5
    assert out.bound >= sum(want.values()) - 1e-6
    if not out.excess:
        assert all(got[b] <= want[b] + 1e-9 for b in want)
    assert out.excess <= 3 and out.value >= 0.93 * sum(want.values())


def test_swaps_against_all_pairs():
    rng = random.Random(3)
    for _ in range(200):
        over, room = rng.randint(1, 9), rng.randint(1, 9)
        mine = sorted({rng.randint(1, 30) for _ in range(rng.randint(1, 6))})
        back = sorted({rng.randint(1, 30) for _ in range(rng.randint(1, 6))})
        sizes = pd.DataFrame(
            [(0, 0, 1, w, rng.random(), f"a{w}", over, room) for w in mine] + [(0, 1, 0, w, rng.random(), f"b{w}", -room, -over) for w in back],
            columns=["bucket", "choice", "to", "w", "loss", "key", "over", "room"])
        pairs = [min(a - b, over) for a in mine for b in back if 0 < a - b <= room]
        got = market.best_swap(sizes)
        assert len(got) == bool(pairs)
        if pairs:
            a, b = int(got["key"].iloc[0][1:]), int(got["other"].iloc[0][1:])
            assert 0 < a - b <= room and min(a - b, over) == got["lowers"].iloc[0]
            assert got["lowers"].iloc[0] >= min(max(pairs), min(over, room)) - 1e-9


def test_chains_fill_room_and_prove_none():
    held, caps = np.array([6.0, 4.0, 1.0]), np.array([3.0, 4.0, 9.0])
    reach = np.array([[6.0, 6.0, 0.0], [0.0, 4.0, 4.0], [0.0, 0.0, 1.0]])

    def plan(planner, cheap, prices=np.zeros(3)):
        return {j: list(a) for j, a, _ in planner(market.Holding(caps, held, reach, cheap, prices, 1e-6))}

    assert plan(market.chains, np.zeros((3, 3))) == {0: [0.0, 3.0, 0.0], 1: [0.0, 0.0, 3.0]}
    reach[0, 2] = 6.0
    assert plan(market.chains, np.zeros((3, 3))) == {0: [0.0, 0.0, 3.0]}
    cheap = np.array([[6.0, 2.0, 0.0], [0.0, 4.0, 4.0], [0.0, 0.0, 1.0]])
    assert plan(market.chains, cheap) == {0: [0.0, 2.0, 0.0], 1: [0.0, 0.0, 2.0]}
    held[0] = 3.0
    assert plan(market.chains, cheap) == {}
    assert plan(market.priced_chains, cheap, np.array([0.1, 0.5, 0.3])) == {0: [0.0, 2.0, 0.0], 1: [0.0, 0.0, 2.0]}
    assert plan(market.priced_chains, cheap, np.array([0.3, 0.5, 0.3])) == {}
    reach[0, 2] = reach[1, 2] = 0.0
    held[0] = 6.0
    assert list(plan(market.chains, np.zeros((3, 3)))) == [-1]


def test_prices_lower_the_smooth_bound():
    """The Newton step against many random prices within reach, on the smooth bound itself."""
    rng = np.random.default_rng(5)
    u, caps, tau = rng.random((400, 3)), np.array([100.0, 150.0, 180.0]), 0.05

    def smooth(p):
        z = (u - p) / tau
        return float((tau * np.log(np.exp(z).sum(axis=1))).sum() + p @ caps)

    p = np.zeros(3)
    for _ in range(30):
        z = np.exp((u - p) / tau)
        share = z / z.sum(axis=1, keepdims=True)
        p = market.next_prices(caps, p, tau, share.sum(axis=0), share.T @ share, 400.0, tau)
    assert (p >= 0).all()
    assert smooth(p) <= min(smooth(np.maximum(p + rng.normal(0, 0.05, 3), 0)) for _ in range(300)) + 1e-6


@pytest.mark.parametrize("ties", [False, True])
def test_quotas_rules_and_gap(spark, ties):
    m, ratios, n, buckets = 4, [0.3, 0.4, 0.3, 0.0], 2000, 3
    rows, df = users(spark, n, m, 9, ties)
    df = df.where("r0 is distinct from 0 or r1 is distinct from 0 or r2 is distinct from 0")
    out = quotas.allocate_with_quotas(df, "uid", [f"s{i}" for i in range(m)], ratios, 1.1, "x", buckets,
                                      [f"r{i}" for i in range(m)])
    got = out.frame.collect()
    assert len(got) == df.count() == len({r["uid"] for r in got})
    size = Counter(r["bucket"] for r in got)
    for (b, j), k in Counter((r["bucket"], r["item_idx"]) for r in got).items():
        assert k <= math.ceil(size[b] * ratios[j] * 1.1)
    assert all(rows[r["uid"]][1 + m + r["item_idx"]] != 0 for r in got)
    assert out.gap <= 0.01


def test_one_bucket_may_hold_most_users(spark):
    df = spark.range(900).select(F.col("id").alias("uid"), F.rand(1).alias("s0"), F.rand(2).alias("s1"))
    out = quotas.allocate_with_quotas(df, "uid", ["s0", "s1"], [0.1, 0.9], 1.0, "x", 1)
    assert Counter(r["item_idx"] for r in out.frame.collect()) == {0: 90, 1: 810} and out.gap < 1e-3


def test_surplus_moves_along_a_chain(spark):
    """Users of the full first item may only take the second, whose users may take the third."""
    rows = [(u, 0.9, 0.1, None) for u in range(6)] + [(u, None, 0.9, 0.1) for u in range(6, 12)]
    df = spark.createDataFrame(rows, "uid long, s0 double, s1 double, s2 double")
    out = quotas.allocate_with_quotas(df, "uid", ["s0", "s1", "s2"], [0.25, 0.5, 0.25], 1.0, "x", 1)
    got = Counter(r["item_idx"] for r in out.frame.collect())
    assert got == {0: 3, 1: 6, 2: 3}


def test_infeasible_raises(spark):
    df = spark.createDataFrame([(u, 0.5, 0.5, 1, 0) for u in range(10)],
                               "uid long, s0 double, s1 double, r0 int, r1 int")
    with pytest.raises(ValueError):
        quotas.allocate_with_quotas(df, "uid", ["s0", "s1"], [0.5, 0.5], 1.0, "x", 1, ["r0", "r1"])


@pytest.mark.parametrize("weighted", [True, False])
def test_groups_keep_their_quotas(spark, weighted):
    _, df = users(spark, 1500, 3, 4)
    ratios, slack = [0.4, 0.4, 0.3], 1.1
    rows, result = quotas.allocate_groups(df, "uid", ["s0", "s1", "s2"], ratios, slack, [5, 5, 5],
                                          ["r0", "r1", "r2"], count_weighted=weighted)
    got = rows.collect()
    assert len(got) == 1500 and all(r["item_idx"] is not None for r in got)
    for j, n in Counter(r["item_idx"] for r in got).items():
        assert n <= math.ceil(1500 * ratios[j]) * slack
    assert len({(r["group_code"], r["item_idx"]) for r in got}) == len({r["group_code"] for r in got})
    assert result.gap < 0.05


def groups_by_force(weights, values, caps):
    best = None
    for pick in itertools.product(range(len(caps)), repeat=len(weights)):
        load = Counter()
        for w, j in zip(weights, pick):
            load[j] += w
        value = sum(values[i][j] for i, j in enumerate(pick))
        if all(load[j] <= c + 1e-9 for j, c in enumerate(caps)) and value > -math.inf:
            best = value if best is None else max(best, value)
    return best


def test_two_items_are_sorted_by_score_difference(spark):
    df = spark.range(400).select(F.col("id").alias("uid"), F.rand(3).alias("s0"), F.rand(4).alias("s1"))
    out = quotas.allocate_with_quotas(df, "uid", ["s0", "s1"], [0.3, 0.7], 1.0, "x", 1, gap=1e-9)
    rows = [tuple(r) for r in df.collect()]
    # the second item has room for 280 only, so 120 must take the first
    gains = sorted((r[1] - r[2] for r in rows), reverse=True)
    assert Counter(r["item_idx"] for r in out.frame.collect()) == {0: 120, 1: 280}
    assert out.value == pytest.approx(sum(r[2] for r in rows) + sum(gains[:120]), abs=1e-5)


def test_sequence_needs_listed_quotas(spark):
    _, df = users(spark, 20, 2, 1)
    with pytest.raises(ValueError):
        quotas.allocate_sequence(df, "uid", ["a", "b"], ["s0", "s1"], ["s0"], [0.5, 0.5], 1.0, "x", 1)
