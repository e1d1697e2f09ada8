"""Allocation under traffic quotas."""

from pyspark.sql import functions as F

from offerflow.functions import expr as E
from offerflow.operators import quotas
from offerflow.plans.catalog import query
from offerflow.plans.ranks import RANKED
from offerflow.plans.rows import bucket_sql
from offerflow.plans.views import CODES, ITEMS, SCORES

OPEN = [0.0, 0.3, 0.4, 0.3, 0.0]
RULES = ["rule_01", "rule_02", "rule_03", "rule_04", "rule_10"]


def ruled_users(t):
    """Scores with rules; the fifth item has no rule of its own."""
    return t.fx_score.join(t.fx_rule, "uid", "left").withColumn("rule_10", F.lit(1))


def stated(out):
    """What is known of an allocation as a whole."""
    return [F.lit(float(v)).alias(n) for n, v in (("value", out.value), ("bound", out.bound), ("gap", out.gap), ("excess", out.excess))]


def eligible(df):
    return df.where(~E.rule_none(["rule_02", "rule_03", "rule_04"]).eqNullSafe(F.lit(0)))


@query()
def allocate_with_quotas(t):
    """Rows-only: iterative; the tests check quotas, rules and the optimality gap, and ``allocation_job`` has a twin."""
    out = quotas.allocate_with_quotas(eligible(ruled_users(t)), "uid", SCORES, OPEN, 1.2, "spring", 4, RULES)
    return out.frame.select("uid", "bucket", "item_idx", *stated(out))


@query(f"""WITH u AS (SELECT {bucket_sql("CAST(uid AS VARCHAR) || 'spring'", 4)} AS bucket FROM fx_score
    LEFT JOIN fx_rule USING (uid) WHERE greatest(rule_02, rule_03, rule_04) IS DISTINCT FROM 0),
  n AS (SELECT bucket, count(*) AS n FROM u GROUP BY bucket)
  SELECT bucket, e.i AS item_idx, CAST(ceil(n * e.r * 1.2::DOUBLE) AS BIGINT) AS cap, true AS quota_holds,
    true AS rules_hold, true AS within_gap FROM n, (VALUES {", ".join(f"({i}, {r}::DOUBLE)" for i, r in enumerate(OPEN))}) e(i, r)""",
       ["fx_score", "fx_rule"])
def quotas_hold(t):
    """Per bucket and item: the cap, whether quota and rules hold in the allocation, and whether its value is
    within the stated gap of the bound."""
    users = eligible(ruled_users(t))
    out = quotas.allocate_with_quotas(users, "uid", SCORES, OPEN, 1.2, "spring", 4, RULES)
    rules = F.get(F.array(*RULES), F.col("item_idx"))
    got = users.withColumn("bucket", E.salted_bucket("uid", "spring", 4)).join(
        out.frame.select("uid", "item_idx"), "uid", "left")
    per = got.groupBy("bucket", "item_idx").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(rules == 0).alias("bad"))
    ratio = F.array(*[F.lit(r) for r in OPEN])
    grid = got.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("item_idx").isNull()).alias("none")
                                     ).select("*", F.posexplode(ratio).alias("item_idx", "r"))
    full = grid.join(per, ["bucket", "item_idx"], "left")
    cap = F.ceil(F.col("size") * F.col("r") * 1.2)
    return full.select("bucket", "item_idx", cap.alias("cap"),
                       ((F.coalesce("n", F.lit(0)) <= cap) & (F.col("none") == 0)).alias("quota_holds"),
                       (F.coalesce("bad", F.lit(0)) == 0).alias("rules_hold"),
                       F.lit(0 <= out.bound - out.value + 1e-6 and out.gap <= quotas.GAP).alias("within_gap"))


@query()
def allocate_groups(t):
    """Rows-only: iterative; the tests check quotas and the gap, and ``allocation_job_groups`` has a twin."""
    users, out = quotas.allocate_groups(eligible(ruled_users(t)), "uid", SCORES, OPEN, 1.1, [5, 5, 5, 5, 2], RULES)
    return users.select("uid", "group_code", "item_idx", *stated(out))


ASSIGN = f"""asg AS (SELECT uid, CAST(1 + {bucket_sql("CAST(uid AS VARCHAR) || 'spring'", 3)} AS INT) AS item_idx
  FROM fx_rule WHERE greatest(rule_02, rule_03, rule_04) IS DISTINCT FROM 0)"""


def assigned(t):
    """A fixed assignment over the open items, for the parts that follow the solver."""
    return eligible(t.fx_rule).select("uid", (1 + E.salted_bucket("uid", "spring", 3)).cast("int").alias("item_idx"))


@query(f"""WITH {ASSIGN}, r AS (SELECT s.*, item_idx, CASE WHEN item_idx IS NULL THEN 'none' ELSE
    list_extract({ITEMS}, item_idx + 1) END AS item FROM fx_score s LEFT JOIN asg USING (uid))
  SELECT uid, CASE WHEN item = 'none' THEN -1 ELSE row_number() OVER (PARTITION BY item ORDER BY
      list_extract([{", ".join(SCORES)}], item_idx + 1) DESC, uid) END AS item_score_rank, item,
    CASE WHEN item = 'none' THEN 97 ELSE list_extract({CODES}, item_idx + 1) END AS item_code FROM r""",
       ["fx_score", "fx_rule"])
def quota_report(t):
    rows, _ = quotas.quota_report(t.fx_score, assigned(t), "uid", ITEMS, CODES, SCORES, OPEN)
    return rows


@query(f"""WITH {ASSIGN}, r AS (SELECT CASE WHEN item_idx IS NULL THEN 'none' ELSE
    list_extract({ITEMS}, item_idx + 1) END AS item FROM fx_score s LEFT JOIN asg USING (uid))
  SELECT e.item, e.code AS item_code, e.ratio AS expected_ratio, count(r.item) AS n_users,
    round(count(r.item) / (SELECT count(*) FROM r), 3) AS share
  FROM (VALUES {", ".join(f"('{i}', {c}, {r}::DOUBLE)" for i, c, r in
        zip([*ITEMS, "none"], [*CODES, 97], [*OPEN, 0.0]))}) e(item, code, ratio)
  LEFT JOIN r ON r.item = e.item GROUP BY e.item, e.code, e.ratio""", ["fx_score", "fx_rule"])
def quota_traffic(t):
    _, traffic = quotas.quota_report(t.fx_score, assigned(t), "uid", ITEMS, CODES, SCORES, OPEN)
    return traffic


@query(f"""WITH {ASSIGN}, k AS (SELECT r.*, list_extract({ITEMS}, item_idx + 1) AS own FROM ({RANKED}) r
    LEFT JOIN asg USING (uid))
  SELECT uid, string_agg(item, '-' ORDER BY (item IS DISTINCT FROM own), r) AS item_order,
    string_agg(printf('%.10f', score), '-' ORDER BY (item IS DISTINCT FROM own), r) AS score_order
  FROM k GROUP BY uid""", ["fx_score", "fx_rule"])
def sequence_rows(t):
    names = F.array(*[F.lit(i) for i in ITEMS])
    own = assigned(t).select("uid", F.get(names, F.col("item_idx")).alias("item"))
    return quotas.sequence_rows(t.fx_score, own, "uid", ITEMS, SCORES)


@query()
def allocate_sequence(t):
    """Rows-only: the ordered lists of the solver's own assignment."""
    return quotas.allocate_sequence(
        ruled_users(t), "uid", ITEMS, SCORES, ["score_02", "score_03", "score_04"], OPEN, 1.2, "autumn", 4,
        RULES, ["rule_02", "rule_03", "rule_04"])
