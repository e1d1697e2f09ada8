"""Whole jobs: dated partitions in, one dated partition out, read back."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from offerflow.functions import expr as E
from offerflow.operators import jobs
from offerflow.plans.bands import X, conditional_sql, f_tail_sql
from offerflow.plans.catalog import query
from offerflow.plans.models import KEYS
from offerflow.plans.rows import bucket_sql
from offerflow.plans.scores import rounded
from offerflow.plans.views import CODES, ITEMS
from offerflow.session import scratch_folder
from offerflow.sources.partitions import write_partition


def folder(t) -> str:
    return f"{scratch_folder(t.spark)}/job-{uuid.uuid4().hex}"


# --- several models in one job ---------------------------------------------------------------------

def load_linear():
    w = np.array([1.2, -0.8, 0.5])
    return lambda x: 1.0 / (1.0 + np.exp(-(x @ w - 0.1)))


def load_balance():
    return lambda x: np.stack([1.0 / (1.0 + np.exp(-x[:, 0] * 2.0)), 1.0 / (1.0 + np.exp(-(x[:, 1] - x[:, 0])))], axis=1)


BUY = "1 / (1 + exp(-(coalesce(score_01, 0) * 1.2 - coalesce(score_02, 0.5) * 0.8 + coalesce(score_03, 0) * 0.5 - 0.1)))"
STAY = "1 / (1 + exp(-coalesce(balance, 0.25) * 2.0))"
MOVE = "1 / (1 + exp(-(coalesce(score_02, 0) - coalesce(balance, 0.25))))"


@query(f"""SELECT uid, round(buy / (buy + (1 - buy) / 0.2), 6) AS buy, round(stay, 6) AS stay,
    round(move / (move + (1 - move) * 0.3 + (1 - move) * 0.7 / 0.5), 6) AS move FROM (
  SELECT c_custkey AS uid, {BUY} AS buy, {STAY} AS stay, {MOVE} AS move FROM customer LEFT JOIN (
    SELECT * FROM fx_score WHERE group_index <> 3) s ON uid = c_custkey LEFT JOIN (
    SELECT c_custkey AS k, c_acctbal / 10000 AS balance FROM customer WHERE c_custkey % 7 <> 0) b ON k = c_custkey)""", ["fx_score"])
def scoring_models_job(t):
    """Two models with their own features, fill values and calibrations, from two feature tables."""
    root = folder(t)
    write_partition(t.customer.select(F.col("c_custkey").alias("uid")), f"{root}/people", "2024-02-01")
    write_partition(t.fx_score.where("group_index <> 3").select("uid", "score_01", "score_02", "score_03"), f"{root}/scores", "2024-01-31")
    write_partition(t.customer.where("c_custkey % 7 <> 0").select(
        F.col("c_custkey").alias("uid"), (F.col("c_acctbal") / 10000).alias("balance")), f"{root}/balances", "2024-01-31")
    models = [
        jobs.ScoringModel(["buy"], {"score_01": 0.0, "score_02": 0.5, "score_03": 0.0}, load_linear,
                          {"buy": lambda s: E.calibrate_neg_sampling(s, 0.2)}),
        jobs.ScoringModel(["stay", "move"], {"balance": 0.25, "score_02": 0.0}, load_balance,
                          {"move": lambda s: E.calibrate_chain(s, F.lit(0.7), 0.5)})]
    out = jobs.scoring_models_job(
        t.spark, f"{root}/people", [(f"{root}/scores", ["score_01", "score_02", "score_03"]), (f"{root}/balances", ["balance"])],
        f"{root}/published", "2024-02-01", "2024-01-31", "uid", models, role="2", exp_mode="base")
    return rounded(out.select("uid", "buy", "stay", "move"), buy=6, stay=6, move=6)


# --- uplift scores ---------------------------------------------------------------------------------

SHARES = {"treatment_1": 0.07, "treatment_2": 0.29, "treatment_3": 0.5, "treatment_4": 0.05}
SLOPES = {"treatment_1": (0.3, -0.2), "treatment_2": (0.1, 0.4), "treatment_3": (-0.5, 0.2), "treatment_4": (0.8, 0.6)}


def load_effects():
    def pair(a, b):
        return (lambda x: a * x[:, 0] + 0.05 * x[:, 1], lambda x: b * np.tanh(x[:, 0]) - 0.02 * x[:, 2])

    return [pair(a, b) for a, b in SLOPES.values()]


@query("SELECT uid, " + ", ".join(
    f"round({p} * ({SLOPES[arm][1]} * tanh(balance) - 0.02 * score_02) + {1 - p} * ({SLOPES[arm][0]} * balance + 0.05 * score_01), 6)"
    f" AS score_{arm}" for arm, p in SHARES.items()) + """ FROM (SELECT c_custkey AS uid, c_acctbal / 10000 AS balance,
    coalesce(score_01, 0) AS score_01, coalesce(score_02, 0.3) AS score_02 FROM customer LEFT JOIN fx_score ON uid = c_custkey)""", ["fx_score"])
def uplift_scoring_job(t):
    """Effects of all arms, blended by their propensities, from one dated table into another."""
    root = folder(t)
    rows = t.customer.select(F.col("c_custkey").alias("uid"), (F.col("c_acctbal") / 10000).alias("balance")).join(
        t.fx_score.select("uid", "score_01", "score_02"), "uid", "left")
    write_partition(rows, f"{root}/features", "2024-01-31")
    out = jobs.uplift_scoring_job(t.spark, f"{root}/features", f"{root}/effects", "2024-01-31", "2024-02-01", "uid",
                                  {"balance": 0.0, "score_01": 0.0, "score_02": 0.3}, list(SHARES), load_effects, list(SHARES.values()))
    names = [f"score_{a}" for a in SHARES]
    return rounded(out.select("uid", *names), **{n: 6 for n in names})


# --- allocation --------------------------------------------------------------------------------------

GROUPS = [0, 1, 2, 4, 6, 7]
PAIR = jobs.Offer(ITEMS[:2], CODES[:2], ["score_a", "score_b"], [0.4, 0.62], ["rule_a", "rule_b"])


def spread_sql(name: str, by: str) -> str:
    """A score in 0..1 per customer, no two with the same difference."""
    at = f"(c_custkey + {'0.5' if name == 'score_a' else '0.25'}) * {by}"
    return f"round({at} - floor({at}), 9) AS {name}"


SPREAD = {"score_a": "0.6180339887498949", "score_b": "0.4142135623730951"}
RULE_A, RULE_B = "CAST(c_custkey % 3 <> 0 AS INT)", "CAST(c_acctbal > 0 AS INT)"


def allocation_inputs(t, root: str) -> tuple[str, list[str], list[str]]:
    day = "2024-02-01"
    write_partition(t.customer.selectExpr("c_custkey AS uid", "CAST(c_custkey % 10 AS INT) AS group_index"), f"{root}/ids", day)
    ruled = t.customer.where("c_custkey % 11 <> 0")
    write_partition(ruled.selectExpr("c_custkey AS uid", f"{RULE_A} AS rule_a"), f"{root}/rule_a", day)
    write_partition(ruled.selectExpr("c_custkey AS uid", f"{RULE_B} AS rule_b"), f"{root}/rule_b", day)
    for name, by in SPREAD.items():
        write_partition(t.customer.selectExpr("c_custkey AS uid", spread_sql(name, f"{by}D")), f"{root}/{name}", day)
    return f"{root}/ids", [f"{root}/rule_a", f"{root}/rule_b"], [f"{root}/{s}" for s in SPREAD]


# Of two items the optimum is known: users that may have both are sorted by the difference of their scores, and the
# first item goes to those above 0, but no more than its quota leaves and no fewer than the second's quota needs.
BEST_OF_TWO = f"""u AS (SELECT c_custkey AS uid, {", ".join(spread_sql(n, f"{by}::DOUBLE") for n, by in SPREAD.items())},
    CASE WHEN c_custkey % 11 <> 0 THEN {RULE_A} END AS rule_a, CASE WHEN c_custkey % 11 <> 0 THEN {RULE_B} END AS rule_b
    FROM customer WHERE c_custkey % 10 IN ({", ".join(map(str, GROUPS))})),
  e AS (SELECT *, {bucket_sql("CAST(uid AS VARCHAR) || 'summer'", 3)} AS bucket, coalesce(rule_a, 1) = 1 AS may_a,
    coalesce(rule_b, 1) = 1 AS may_b FROM u WHERE greatest(rule_a, rule_b) IS DISTINCT FROM 0),
  n AS (SELECT bucket, count(*) AS n, count(*) FILTER (NOT may_b) AS only_a, count(*) FILTER (NOT may_a) AS only_b,
    count(*) FILTER (may_a AND may_b) AS free, count(*) FILTER (may_a AND may_b AND score_a > score_b) AS glad FROM e GROUP BY bucket),
  c AS (SELECT bucket, least(ceil(n * 0.4::DOUBLE) - only_a, greatest(glad, free - (ceil(n * 0.62::DOUBLE) - only_b))) AS take FROM n),
  a AS (SELECT e.uid, CASE WHEN NOT may_b THEN 0 WHEN NOT may_a THEN 1 WHEN row_number() OVER (
      PARTITION BY bucket, may_a AND may_b ORDER BY score_a - score_b DESC) <= take THEN 0 ELSE 1 END AS idx FROM e JOIN c USING (bucket)),
  r AS (SELECT u.*, idx, CASE idx WHEN 0 THEN '{ITEMS[0]}' WHEN 1 THEN '{ITEMS[1]}' ELSE 'none' END AS item,
    CASE idx WHEN 0 THEN {CODES[0]} WHEN 1 THEN {CODES[1]} ELSE 97 END AS item_code FROM u LEFT JOIN a USING (uid))"""


def run_allocation(t, gap: float = 1e-9):
    root = folder(t)
    ids, rules, scores = allocation_inputs(t, root)
    return jobs.allocation_job(t.spark, ids, rules, scores, f"{root}/published", "2024-02-01", "uid", "group_index", GROUPS, PAIR,
                               salt="summer", n_buckets=3, deciding_rules=["rule_a", "rule_b"], gap=gap, role="1")


@query(f"""WITH {BEST_OF_TWO} SELECT uid, CASE WHEN idx IS NULL THEN -1 ELSE row_number() OVER (PARTITION BY idx
    ORDER BY CASE idx WHEN 0 THEN score_a ELSE score_b END DESC, uid) END AS item_score_rank, item, item_code FROM r""")
def allocation_job(t):
    """Ids, rules and scores of a day joined, the experiment's groups, ineligible users apart, allocated in
    salted buckets, ranked, published and read back."""
    rows, _, _ = run_allocation(t)
    return rows.select("uid", "item_score_rank", "item", "item_code")


@query(f"""WITH {BEST_OF_TWO}, v AS (SELECT sum(CASE idx WHEN 0 THEN score_a WHEN 1 THEN score_b END) AS v FROM r)
  SELECT e.item, e.code AS item_code, e.ratio AS expected_ratio, count(r.item) AS n_users, round(count(r.item) / (SELECT count(*) FROM r), 3)
    AS share, round((SELECT v FROM v), 3) AS value, round((SELECT v FROM v), 3) AS bound
  FROM (VALUES ('{ITEMS[0]}', {CODES[0]}, 0.4::DOUBLE), ('{ITEMS[1]}', {CODES[1]}, 0.62::DOUBLE), ('none', 97, 0::DOUBLE)) e(item, code, ratio)
  LEFT JOIN r USING (item) GROUP BY ALL""")
def allocation_job_traffic(t):
    """The job's traffic report, with the allocation's value and its bound, which meet in the optimum."""
    _, traffic, out = run_allocation(t)
    return traffic.withColumns({"value": F.round(F.lit(out.value), 3), "bound": F.round(F.lit(out.bound), 3)})


CELLS = {"score_a": 4, "score_b": 3}
OPEN_PAIR = jobs.Offer(PAIR.items, PAIR.codes, PAIR.scores, [1.0, 1.0], PAIR.rules, 1.0)
SHRUNK = {s: f"{s} * (1 - (1 - coalesce(rule_{s[-1]}, 1)) * (1 - 1e-10::DOUBLE))" for s in CELLS}
CELL_CUTS = ", ".join(f"(SELECT list(DISTINCT c ORDER BY c) FROM (SELECT unnest(quantile_cont({s}, [{', '.join(str(i / n) for i in range(n + 1))}]))"
                      f" AS c FROM w)) AS c_{s}" for s, n in CELLS.items())
CELL_AT = " || '|' || ".join(f"greatest(len(list_filter(c_{s}, lambda c: c < {s})) - 1, 0)" for s in CELLS)


@query(f"""WITH {BEST_OF_TWO}, w AS (SELECT uid, {", ".join(f"{x} AS {s}" for s, x in SHRUNK.items())} FROM e),
  q AS (SELECT {CELL_CUTS}), g AS (SELECT w.*, {CELL_AT} AS cell FROM w, q),
  m AS (SELECT cell, avg(score_a) >= avg(score_b) AS first FROM g GROUP BY cell),
  k AS (SELECT g.uid, CASE WHEN first THEN 0 ELSE 1 END AS idx FROM g JOIN m USING (cell)),
  o AS (SELECT u.*, k.idx FROM u LEFT JOIN k USING (uid))
  SELECT uid, CASE WHEN idx IS NULL THEN -1 ELSE row_number() OVER (PARTITION BY idx
    ORDER BY CASE idx WHEN 0 THEN score_a ELSE score_b END DESC, uid) END AS item_score_rank,
    CASE idx WHEN 0 THEN '{ITEMS[0]}' WHEN 1 THEN '{ITEMS[1]}' ELSE 'none' END AS item,
    CASE idx WHEN 0 THEN {CODES[0]} WHEN 1 THEN {CODES[1]} ELSE 97 END AS item_code FROM o""")
def allocation_job_groups(t):
    """The grouped form of the job, with quotas that leave every score group its best item."""
    root = folder(t)
    ids, rules, scores = allocation_inputs(t, root)
    rows, _, out = jobs.allocation_job(
        t.spark, ids, rules, scores, f"{root}/published", "2024-02-01", "uid", "group_index", GROUPS, OPEN_PAIR,
        quantiles=list(CELLS.values()), deciding_rules=["rule_a", "rule_b"])
    return rows.select("uid", "item_score_rank", "item", "item_code")


# --- feature selection ---------------------------------------------------------------------------------

WEIGHTS = {"x1": 0.03, "x2": -0.00002, "x3": 4.0, "x4": -3.0}
PARTS = [["x1", "x2", "flat"], ["x3", "x4"]]


def picked_score(df):
    """A closed-form model over the features it is given."""
    z = F.lit(-0.2)
    for c, w in WEIGHTS.items():
        if c in df.columns:
            z = z + F.col(c) * w
    return df.withColumn("score", z)


SELECT_ROWS = "f AS (SELECT *, CAST(x1 > 20 AS INT) AS y, 1.0::DOUBLE AS flat FROM fx_label)"


def described_sql(group: int, c: str) -> str:
    return (f"SELECT '{c}' AS feature, {group} AS \"group\", count({c}) AS count, stddev_samp({c}) AS std,"
            f" 100.0 * avg(CAST({c} IS NULL AS INT)) AS miss_percent FROM f")


@query(f"""WITH RECURSIVE {SELECT_ROWS}, d AS ({" UNION ALL ".join(described_sql(g, c) for g, cols in enumerate(PARTS) for c in cols)}),
  lab AS (SELECT x1, x2, x3, x4, item, y AS label FROM f),
  {f_tail_sql(" UNION ALL ".join(conditional_sql(c, "lab") for c in X))}
  SELECT d.feature, "group", count, round(std, 4) AS std, miss_percent, std = 0 AS constant, round(score, 4) AS score, round(p_value, 6) AS p_value,
    coalesce(p_value <= 0.05, false) AS tested FROM d LEFT JOIN tails USING (feature)""", ["fx_label"])
def feature_selection(t):
    """Described, constants dropped, tested within the item, merged; what follows, the shuffled importance, is random and
    left to the tests and to ``permutation_importance``."""
    df = t.fx_label.withColumns({"y": (F.col("x1") > 20).cast("int"), "flat": F.lit(1.0)})
    out = jobs.feature_selection(df, PARTS, KEYS, "y", "item", picked_score)
    return rounded(out.drop("importance", "selected"), std=4, score=4, p_value=6)
