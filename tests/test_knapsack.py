import itertools
import random

import pytest

from offerflow.operators import knapsack


def classes(seed, n, sizes):
    rng = random.Random(seed)
    return {c: [(rng.randint(1, 90), rng.randint(1, 90)) for _ in range(rng.choice(sizes))] for c in range(n)}


def frame(spark, data):
    return spark.createDataFrame([(c, i, float(v), float(w)) for c, items in data.items()
                                  for i, (v, w) in enumerate(items)],
                                 "class_id long, choice int, value double, weight double")


def triple_hull(items):
    """Choices left after the pairwise and the three-point domination tests."""
    order = sorted(range(len(items)), key=lambda i: (items[i][1], -items[i][0], i))
    keep = [i for k, i in enumerate(order) if not any(items[j][0] >= items[i][0] for j in order[:k])]
    return [k for k in keep if not any(
        items[j][1] < items[k][1] < items[m][1]
        and (items[m][0] - items[k][0]) * (items[k][1] - items[j][1])
        >= (items[k][0] - items[j][0]) * (items[m][1] - items[k][1])
        for j in keep for m in keep)]


@pytest.mark.parametrize("chunk", [256, 4])
def test_frontier_equals_triple_test(spark, chunk):
    data = classes(1, 30, [1, 2, 5, 11, 40])
    rows = knapsack.efficient_frontier(frame(spark, data), chunk).collect()
    for c, items in data.items():
        got = [r["choice"] for r in sorted((r for r in rows if r["class_id"] == c), key=lambda r: r["step"])]
        assert got == triple_hull(items)


def test_a_class_that_is_all_frontier(spark):
    """A large class of which nothing can be dropped, beside small ones and one of equal weights."""
    n = 20_000
    big = spark.range(n).selectExpr("CAST(7 AS BIGINT) AS class_id", "CAST(id AS INT) AS choice",
                                    "sqrt(CAST(id + 1 AS DOUBLE)) AS value", "CAST(id + 1 AS DOUBLE) AS weight")
    same = spark.range(500).selectExpr("CAST(8 AS BIGINT) AS class_id", "CAST(id AS INT) AS choice",
                                       "CAST(id % 250 AS DOUBLE) AS value", "2D AS weight")
    under = spark.range(3000).selectExpr("CAST(9 AS BIGINT) AS class_id", "CAST(id AS INT) AS choice",
                                         "IF(id = 2999, 5D, -CAST(id AS DOUBLE)) AS value", "CAST(id AS DOUBLE) AS weight")
    rows = knapsack.frontier_table(big.union(same).union(under), 200)
    got = {c: sorted((r for r in rows.collect() if r["class_id"] == c), key=lambda r: r["step"]) for c in (7, 8, 9)}
    assert [r["choice"] for r in got[7]] == list(range(n)) == [r["step"] for r in got[7]]
    assert [(r["choice"], r["weight"]) for r in got[8]] == [(249, 2.0)]
    assert [r["choice"] for r in got[9]] == [0, 2999] and got[9][1]["eff"] == 5 / 2999
    assert all(a["eff"] > b["eff"] for a, b in zip(got[7][1:], got[7][2:]))


def test_undominated(spark):
    data = classes(2, 20, [1, 3, 9])
    rows = knapsack.undominated(frame(spark, data)).collect()
    for c, items in data.items():
        got = {r["choice"] for r in rows if r["class_id"] == c}
        want = {i for i, (v, w) in enumerate(items) if not any(
            (w2, -v2, j) < (w, -v, i) and v2 >= v for j, (v2, w2) in enumerate(items))}
        assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    data = classes(seed, 4, [3, 4, 6])
    df = frame(spark, data)
    lightest = sum(min(w for _, w in items) for items in data.values())
    budget = float(lightest + 60)
    best = max(sum(v for v, _ in pick) for pick in itertools.product(*data.values())
               if sum(w for _, w in pick) <= budget)
    whole = knapsack.knapsack_integer(df, budget).collect()
    price, chosen, bound = knapsack.knapsack_price(df, budget)
    part = knapsack.knapsack_greedy(df, budget).collect()
    assert len(whole) == len(data) and sum(r["weight"] for r in whole) <= budget + 1e-9
    assert sum(r["value"] for r in whole) <= best
    relaxed = sum(r["value"] * r["proportion"] for r in part)
    assert best <= relaxed + 1e-9 and relaxed == pytest.approx(bound)
    assert sum(r["weight"] * r["proportion"] for r in part) <= budget + 1e-9
    moved = {r["class_id"]: r["choice"] for r in chosen.collect()}
    assert sum(moved[r["class_id"]] != r["choice"] for r in whole) <= len(data)
    assert sum(r["weight"] for r in chosen.collect()) <= budget + 1e-9 and price.alpha >= 0


def test_budget_limits(spark):
    df = frame(spark, {1: [(1, 5), (9, 8)], 2: [(2, 3), (4, 4)]})
    with pytest.raises(ValueError):
        knapsack.knapsack_integer(df, 7.0)
    rich = knapsack.knapsack_integer(df, 100.0).collect()
    assert {(r["class_id"], r["choice"]) for r in rich} == {(1, 1), (2, 1)}
    exact = knapsack.knapsack_greedy(df, 11.0).collect()  # 5 + 3, then the move of 3
    assert {(r["class_id"], r["choice"], r["proportion"]) for r in exact} == {(1, 1, 1.0), (2, 0, 1.0)}


def test_many_equal_classes(spark):
    """All moves have the same price; the order of the classes decides."""
    df = frame(spark, {c: [(1, 1), (3, 2)] for c in range(50)})
    rows = knapsack.knapsack_integer(df, 70.0).collect()
    assert sorted(r["class_id"] for r in rows if r["choice"] == 1) == list(range(20))


def test_coupon_tiers(spark):
    users = spark.createDataFrame([(g, g % 3, 0.1 + g / 50, 0.2 + g / 40) for g in range(30) for _ in range(3)],
                                  "g int, tier int, a double, b double")
    out = knapsack.coupon_budget(users, ["g", "tier"], "tier", {0.5: "a", 1.0: "b"},
                                 {0: [0.5], 1: [0.5, 1.0], 2: [1.0]}, 0.8).collect()
    assert len(out) == 30 and sum(r["coupon"] * r["n_users"] for r in out) <= 0.8 * 90 + 1e-9
    assert all(r["coupon"] == 0.5 for r in out if r["tier"] == 0)
    assert all(r["coupon"] == 1.0 for r in out if r["tier"] == 2)
