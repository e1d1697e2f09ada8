"""Choices under a budget."""

from pyspark.sql import functions as F

from offerflow.functions import expr as E
from offerflow.operators import knapsack
from offerflow.plans.catalog import query
from offerflow.plans.scores import rounded

# Lightest-first, then by value; ties on both go to the lower choice number.
UND = """und AS (SELECT * FROM {src} k WHERE NOT EXISTS (SELECT 1 FROM {src} j WHERE j.class_id = k.class_id
    AND j.weight <= k.weight AND j.value >= k.value AND (j.weight < k.weight OR j.value > k.value
    OR j.choice < k.choice)))"""
HULL = """hull AS (SELECT *, CAST(row_number() OVER (PARTITION BY class_id ORDER BY weight) - 1 AS INT) AS step
    FROM und k WHERE NOT EXISTS (SELECT 1 FROM und j JOIN und l ON l.class_id = j.class_id
    WHERE j.class_id = k.class_id AND j.weight < k.weight AND k.weight < l.weight
    AND (l.value - k.value) / (l.weight - k.weight) >= (k.value - j.value) / (k.weight - j.weight)))"""
STEPS = """st AS (SELECT class_id, step, dw, dv / dw AS eff, sum(dw) OVER (ORDER BY dv / dw DESC, class_id, step
    ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT class_id, step,
    weight - lag(weight) OVER (PARTITION BY class_id ORDER BY step) AS dw,
    value - lag(value) OVER (PARTITION BY class_id ORDER BY step) AS dv FROM hull) WHERE step > 0),
  lim AS (SELECT {budget} - (SELECT sum(weight) FROM hull WHERE step = 0) AS lft),
  got AS (SELECT class_id, count(*) FILTER (cum <= lft + 1e-6) AS k,
    max(CASE WHEN cum > lft + 1e-6 AND cum - dw < lft - 1e-6 THEN (lft - (cum - dw)) / dw END) AS f
    FROM st, lim GROUP BY class_id)"""
BUDGET = "(SELECT count(DISTINCT class_id)::DOUBLE FROM fx_choice)"
ALL = "WITH " + UND.format(src="fx_choice") + ", " + HULL


def classes(t):
    """Choices and a budget of 1.0 per class."""
    df = t.fx_choice
    return df, float(df.select("class_id").distinct().count())


@query("WITH bent AS (SELECT class_id, choice, CASE WHEN choice = 3 THEN value * 0.6::DOUBLE ELSE value END AS value, "
       "weight FROM fx_choice), " + UND.format(src="bent") + " SELECT class_id, choice, value, weight FROM und",
       ["fx_choice"])
def undominated(t):
    bent = F.when(F.col("choice") == 3, F.col("value") * 0.6).otherwise(F.col("value"))
    return knapsack.undominated(t.fx_choice.withColumn("value", bent))


@query("WITH bent AS (SELECT class_id, choice, CASE WHEN choice = 2 THEN value * 0.85::DOUBLE ELSE value END AS value, "
       "weight FROM fx_choice), " + UND.format(src="bent") + ", " + HULL
       + " SELECT class_id, step, choice, value, weight FROM hull", ["fx_choice"])
def efficient_frontier(t):
    bent = F.when(F.col("choice") == 2, F.col("value") * 0.85).otherwise(F.col("value"))
    return knapsack.efficient_frontier(t.fx_choice.withColumn("value", bent))


@query(ALL + ", " + STEPS.format(budget=BUDGET) + """
  SELECT h.class_id, h.choice, h.value, h.weight, round(CASE WHEN f IS NULL THEN 1 WHEN h.step = coalesce(k, 0) THEN 1 - f
    ELSE f END, 5) AS proportion FROM hull h LEFT JOIN got g ON g.class_id = h.class_id
  WHERE h.step = coalesce(k, 0) OR (f IS NOT NULL AND h.step = k + 1)""", ["fx_choice"])
def knapsack_greedy(t):
    return rounded(knapsack.knapsack_greedy(*classes(t)), proportion=5)


@query(ALL + ", " + STEPS.format(budget=BUDGET) + """
  SELECT h.class_id, h.choice, h.value, h.weight FROM hull h LEFT JOIN got g ON g.class_id = h.class_id
  WHERE h.step = coalesce(k, 0)""", ["fx_choice"])
def knapsack_integer(t):
    return knapsack.knapsack_integer(*classes(t))


@query(ALL + ", " + STEPS.format(budget=BUDGET) + """,
  alpha AS (SELECT max(eff) AS a FROM st, lim WHERE cum > lft + 1e-6)
  SELECT h.class_id, h.choice, h.value, h.weight FROM hull h
  LEFT JOIN (SELECT class_id, count(*) AS k FROM st, alpha WHERE eff > a GROUP BY class_id) g
    ON g.class_id = h.class_id WHERE h.step = coalesce(k, 0)""", ["fx_choice"])
def knapsack_price(t):
    _, chosen, _ = knapsack.knapsack_price(*classes(t))
    return chosen


AMOUNTS = [0.2, 0.5, 1.0, 1.5, 1.8]
ALLOWED = {2: [1.0, 1.5, 1.8], 1: [0.5, 1.0, 1.5], 0: [0.2, 0.5, 1.0]}
SCORED = {a: f"p_{i}" for i, a in enumerate(AMOUNTS)}
COUPON = f"""u AS (SELECT c_nationkey, c_mktsegment, CASE WHEN c_acctbal < 2000 THEN 0 WHEN c_acctbal < 6000 THEN 1
    ELSE 2 END AS tier, score_02, score_04 FROM customer JOIN fx_score ON uid = c_custkey),
  g AS (SELECT c_nationkey, c_mktsegment, tier, count(*) AS n_users,
    {", ".join(f"sum(score_02 + score_04 * sqrt({a}::DOUBLE)) AS value_{i}" for i, a in enumerate(AMOUNTS))}
    FROM u GROUP BY ALL),
  offer AS ({" UNION ALL ".join(
    f"SELECT (c_nationkey, c_mktsegment, tier) AS class_id, {i} AS choice, round(value_{i}, 9) AS value, "
    f"n_users * {a}::DOUBLE AS weight FROM g WHERE tier IN ({', '.join(str(t) for t, ok in ALLOWED.items() if a in ok)})"
    for i, a in enumerate(AMOUNTS))}),
  {UND.format(src="offer")}, {HULL}, {STEPS.format(budget="(SELECT sum(n_users) * 1.1::DOUBLE FROM g)")},
  alloc AS (SELECT g.c_nationkey, g.c_mktsegment, g.tier, list_extract({AMOUNTS}, h.choice + 1)::DOUBLE AS coupon,
    h.value, h.weight, g.n_users FROM hull h LEFT JOIN got ON got.class_id = h.class_id
    JOIN g ON (g.c_nationkey, g.c_mktsegment, g.tier) = h.class_id WHERE h.step = coalesce(k, 0))"""


def coupon_users(t):
    users = t.customer.join(t.fx_score, F.col("uid") == F.col("c_custkey"))
    tier = E.ladder("c_acctbal", [(2000.0, "0"), (6000.0, "1")], "2").cast("int")
    return users.select("c_nationkey", "c_mktsegment", tier.alias("tier"), *[
        (F.col("score_02") + F.col("score_04") * F.sqrt(F.lit(a))).alias(c) for a, c in SCORED.items()])


GROUP = ["c_nationkey", "c_mktsegment", "tier"]


@query(f"WITH {COUPON} SELECT c_nationkey, c_mktsegment, tier, coupon, round(value, 6) AS value, "
       "round(weight, 6) AS weight, n_users FROM alloc", ["fx_score"])
def coupon_budget(t):
    out = knapsack.coupon_budget(coupon_users(t), GROUP, "tier", SCORED, ALLOWED, 1.1)
    return rounded(out, value=6, weight=6)


@query(f"""WITH {COUPON}, own AS (SELECT sum(value) AS v, sum(coupon * n_users) / sum(n_users) AS c FROM alloc)
  SELECT 'allocation' AS policy, round(v, 5) AS value, round(c, 6) AS mean_cost, 0::BIGINT AS violations,
    0::DOUBLE AS gain FROM own UNION ALL """ + " UNION ALL ".join(
    f"SELECT 'uniform {a}', round(sum(value_{i}), 5), {a}::DOUBLE, 0, round((min(v) - sum(value_{i})) / sum(value_{i}), 6)"
    " FROM g, own" for i, a in enumerate(AMOUNTS)), ["fx_score"])
def budget_report(t):
    users = coupon_users(t)
    alloc = knapsack.coupon_budget(users, GROUP, "tier", SCORED, ALLOWED, 1.1)
    groups = knapsack.coupon_groups(users, GROUP, SCORED)
    out = knapsack.budget_report(groups, alloc, GROUP, "tier", SCORED, ALLOWED)
    return rounded(out, value=5, mean_cost=6, gain=6)
