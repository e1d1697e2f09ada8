"""Row rules: dates, mappings, rules, calibration, labels, weights, buckets."""

from pyspark.sql import functions as F

from offerflow.functions import expr as E
from offerflow.operators import joins
from offerflow.plans.catalog import query

HASH32 = "('0x' || substr({h}, {k}, 8))::BIGINT"


def bucket_sql(text: str, n: int) -> str:
    """SQL twin of salted_bucket over an SQL text expression."""
    h = f"md5(sha1({text}))"
    acc = "0::BIGINT"
    for k in range(4):
        part = HASH32.format(h=h, k=1 + 8 * k)
        acc = f"((({acc}) * {2 ** 32 % n} + {part}) % {n})"
    return acc


def hash_sql(text: str) -> str:
    """SQL twin of hash_order over an SQL text expression."""
    return HASH32.format(h=f"md5({text})", k=1)


@query("""SELECT event_id, CASE WHEN dt <= DATE '2024-01-08' THEN DATE '2024-01-01'
  WHEN dt <= DATE '2024-01-15' THEN DATE '2024-01-08'
  WHEN dt <= DATE '2024-01-22' THEN DATE '2024-01-15' END AS obs_day FROM fx_positive""",
       ["fx_positive"])
def bucket_dates(t):
    cuts = [("2024-01-08", "2024-01-01"), ("2024-01-15", "2024-01-08"),
            ("2024-01-22", "2024-01-15")]
    return t.fx_positive.select("event_id", E.bucket_dates("dt", cuts).alias("obs_day"))


@query("SELECT event_id, CAST(isodow(dt) - 1 AS INT) AS weekday FROM fx_positive",
       ["fx_positive"])
def weekday(t):
    return t.fx_positive.select("event_id", E.weekday("dt").alias("weekday"))


@query("""SELECT uid, treatment, CASE treatment WHEN 'treatment_1' THEN 20
  WHEN 'treatment_2' THEN 50 WHEN 'treatment_3' THEN 100 ELSE 0 END AS cents
  FROM fx_experiment""", ["fx_experiment"])
def map_values(t):
    cents = {"treatment_1": 20, "treatment_2": 50, "treatment_3": 100}
    return t.fx_experiment.select("uid", "treatment",
                                  E.map_values("treatment", cents, 0).alias("cents"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  coalesce(n_name, 'other') AS nation FROM lineitem
  LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0
  LEFT JOIN nation ON n_nationkey = s_nationkey""")
def map_values_table(t):
    names = (t.supplier.where("s_acctbal > 0")
             .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
             .select("s_suppkey", "n_name"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joins.map_values_join(rows, "l_suppkey", names, "s_suppkey", "n_name", "nation",
                                 default="other")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN x3 = 0 THEN NULL ELSE x4 / x3 END AS ratio,
  CASE WHEN x2 < 20000 THEN 'low' WHEN x2 < 60000 THEN 'mid' ELSE 'high' END AS era
  FROM fx_label""", ["fx_label"])
def ratio_and_era(t):
    return t.fx_label.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        E.ratio("x4", "x3").alias("ratio"),
        E.ladder("x2", [(20000.0, "low"), (60000.0, "mid")], "high").alias("era"))


@query("""SELECT c.c_custkey AS uid, coalesce(score_01, 0) AS score_01,
  coalesce(score_02, -1) AS score_02 FROM customer c LEFT JOIN fx_score s
  ON s.uid = c.c_custkey""", ["fx_score"])
def fill_missing(t):
    users = t.customer.select(F.col("c_custkey").alias("uid"))
    joined = users.join(t.fx_score.select("uid", "score_01", "score_02"), "uid", "left")
    return E.fill_missing(joined, {"score_01": 0.0, "score_02": -1.0})


@query("""SELECT c_custkey AS uid, CASE WHEN c_nationkey BETWEEN 0 AND 18 THEN c_nationkey
  ELSE 19 END AS nation_code FROM customer""")
def clip_category(t):
    return t.customer.select(F.col("c_custkey").alias("uid"),
                             E.clip_category("c_nationkey", 19).alias("nation_code"))


@query("""SELECT uid, score_01 * (1.0::DOUBLE - (1.0::DOUBLE - rule_01) * (1.0::DOUBLE - 1e-10::DOUBLE)) AS s_01,
  score_02 * (1.0::DOUBLE - (1.0::DOUBLE - rule_02) * (1.0::DOUBLE - 1e-10::DOUBLE)) AS s_02
  FROM fx_score JOIN fx_rule USING (uid)""", ["fx_score", "fx_rule"])
def apply_rule_weight(t):
    return t.fx_score.join(t.fx_rule, "uid").select(
        "uid", E.apply_rule_weight("score_01", "rule_01").alias("s_01"),
        E.apply_rule_weight("score_02", "rule_02").alias("s_02"))


@query("SELECT uid, greatest(rule_01, rule_02, rule_03, rule_04) AS rule_none FROM fx_rule",
       ["fx_rule"])
def rule_none(t):
    return t.fx_rule.select(
        "uid", E.rule_none(["rule_01", "rule_02", "rule_03", "rule_04"]).alias("rule_none"))


@query("""SELECT uid, rule_01 & rule_02 AS rule_12, score_01 * score_10 AS score_110
  FROM fx_score JOIN fx_rule USING (uid)""", ["fx_score", "fx_rule"])
def combine_rules_scores(t):
    return t.fx_score.join(t.fx_rule, "uid").select(
        "uid", E.combine_rules("rule_01", "rule_02").alias("rule_12"),
        E.combine_scores("score_01", "score_10").alias("score_110"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  score / (score + (1.0::DOUBLE - score) / 0.1::DOUBLE) AS calibrated FROM fx_label""",
       ["fx_label"])
def calibrate_neg_sampling(t):
    return t.fx_label.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             E.calibrate_neg_sampling("score", 0.1).alias("calibrated"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  score / (score + (1.0::DOUBLE - score) * (1.0::DOUBLE - x3)
    + (1.0::DOUBLE - score) * x3 / 0.1::DOUBLE) AS calibrated FROM fx_label""", ["fx_label"])
def calibrate_chain(t):
    return t.fx_label.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             E.calibrate_chain("score", "x3", 0.1).alias("calibrated"))


@query("""SELECT o_orderkey, CAST(lvl >= 1 AS INT) AS label_ge_1, CAST(lvl >= 2 AS INT) AS label_ge_2
  FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'F' THEN 1 ELSE 0 END AS lvl
  FROM orders)""")
def ordinal_labels(t):
    level = E.map_values("o_orderstatus", {"P": 2, "F": 1}, 0)
    return t.orders.select("o_orderkey", *E.ordinal_labels(level, 2))


@query("""SELECT uid, greatest(score_01, 1e-7::DOUBLE) AS p1,
  greatest(greatest(score_01, 1e-7::DOUBLE) * score_02, 1e-7::DOUBLE) AS p2,
  greatest(greatest(greatest(score_01, 1e-7::DOUBLE) * score_02, 1e-7::DOUBLE) * score_03,
    1e-7::DOUBLE) AS p3 FROM fx_score""", ["fx_score"])
def funnel_probability(t):
    steps = E.funnel_probability(["score_01", "score_02", "score_03"])
    return t.fx_score.select("uid", *[p.alias(f"p{i + 1}") for i, p in enumerate(steps)])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN item = 'O' AND label = 1 THEN 1 WHEN x1 < 10 THEN 2 ELSE 10 END AS weight
  FROM fx_label""", ["fx_label"])
def sample_weights(t):
    rules = [((F.col("item") == "O") & (F.col("label") == 1), 1), (F.col("x1") < 10, 2)]
    return t.fx_label.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             E.sample_weight(rules, 10).alias("weight"))


@query("""SELECT uid, item_id, round(1 / (1 + exp(-greatest(-1.0::DOUBLE, least(1.0::DOUBLE,
    list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v)) + 1e-8::DOUBLE))))), 6)
  AS score FROM (SELECT uid, item_id, a.embedding::DOUBLE[] AS u, b.embedding::DOUBLE[] AS v
  FROM fx_embed_user a JOIN fx_embed_item b ON a.label = b.label)""",
       ["fx_embed_user", "fx_embed_item"])
def cosine_sigmoid(t):
    items = t.fx_embed_item.select("item_id", "label", F.col("embedding").alias("v"))
    return t.fx_embed_user.join(items, "label").select(
        "uid", "item_id", F.round(E.cosine_sigmoid("embedding", "v"), 6).alias("score"))


@query(f"""SELECT c_custkey AS uid, CAST({bucket_sql("CAST(c_custkey AS VARCHAR) || 'spring'", 100)}
  AS BIGINT) AS bucket FROM customer""")
def salted_bucket(t):
    return t.customer.select(F.col("c_custkey").alias("uid"),
                             E.salted_bucket("c_custkey", "spring", 100).alias("bucket"))


@query("""SELECT event_id, item FROM fx_positive WHERE item IN ('click', 'purchase')""",
       ["fx_positive"])
def activity_filter(t):
    return t.fx_positive.where(E.in_list("item", ["click", "purchase"])).select("event_id", "item")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
  WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)""")
def activity_filter_table(t):
    active = t.part.where("p_size > 25").select("p_partkey")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joins.keep_items(rows, "l_partkey", active)
