"""Applying models, and what is learnt from Spark models."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from offerflow.functions import expr as E
from offerflow.operators import effects, evaluate, profile, scoring, selection, split
from offerflow.plans.catalog import query
from offerflow.plans.rows import hash_sql
from offerflow.plans.scores import ARMS, experiment, rounded
from offerflow.plans.views import ITEMS, SCORES
from offerflow.session import scratch_folder
from offerflow.sources.partitions import read_partition, write_partition

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K = ", ".join(KEYS)
X = ["x1", "x2", "x3", "x4"]


# --- applying a model --------------------------------------------------------------

def load_logistic():
    """A closed-form stand-in for a stored model."""
    w = np.array([0.03, -0.00002, 4.0, -3.0])
    return lambda x: 1.0 / (1.0 + np.exp(-(x @ w - 0.2)))


LOGISTIC = "1 / (1 + exp(-(x1 * 0.03 - x2 * 0.00002 + x3 * 4.0 - x4 * 3.0 - 0.2)))"


@query(f"SELECT {K}, round({LOGISTIC}, 6) AS score FROM fx_label", ["fx_label"])
def score_batches(t):
    return rounded(scoring.score_batches(t.fx_label, load_logistic, X, KEYS), score=6)


BIAS = dict(zip(ITEMS, (0.4, -0.3, 0.1, -0.8, 0.25)))


def load_item_model():
    """One condition per item, then two features."""
    w = np.array([*BIAS.values(), 1.5, -0.7])
    return lambda x: 1.0 / (1.0 + np.exp(-(x @ w)))


def item_score(item: str) -> str:
    return f"1 / (1 + exp(-({BIAS[item]} + score_01 * 1.5 - score_02 * 0.7)))"


def item_scores(t):
    return scoring.score_items(t.fx_score, load_item_model, ["score_01", "score_02"], ["uid"], scoring.one_hot_items(ITEMS))


@query("SELECT uid, " + ", ".join(f"round({item_score(i)}, 6) AS score_{i}" for i in ITEMS) + " FROM fx_score", ["fx_score"])
def score_items(t):
    return rounded(item_scores(t), **{f"score_{i}": 6 for i in ITEMS})


@query(" UNION ALL ".join(f"SELECT uid, '{i}' AS item, round({item_score(i)}, 6) AS score FROM fx_score" for i in ITEMS), ["fx_score"])
def score_items_long(t):
    return rounded(scoring.scores_long(item_scores(t), ["uid"], ITEMS), score=6)


COSINE = """list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v)) + 1e-8::DOUBLE)"""
PAIRS = f"""p AS (SELECT uid, b.label, item_id, 1 / (1 + exp(-greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {COSINE})))) AS s
  FROM (SELECT uid, embedding::DOUBLE[] AS u FROM fx_embed_user) a,
  (SELECT item_id, label, embedding::DOUBLE[] AS v FROM fx_embed_item) b)"""


@query(f"WITH {PAIRS} SELECT uid, " + ", ".join(
    f"round(max(CASE WHEN label = {i} THEN s END), 6) AS score_{i}" for i in range(10)) + " FROM p GROUP BY uid",
       ["fx_embed_user", "fx_embed_item"])
def score_embeddings(t):
    out = scoring.score_embeddings(t.fx_embed_user, t.fx_embed_item, "uid", "label", "embedding", list(range(10)))
    return rounded(out, **{c: 6 for c in out.columns if c != "uid"})


@query(f"WITH {PAIRS} SELECT uid, item_id, round(s, 6) AS score FROM p", ["fx_embed_user", "fx_embed_item"])
def score_embedding_pairs(t):
    out = scoring.score_embedding_pairs(t.fx_embed_user, t.fx_embed_item, "uid", "item_id", "embedding")
    return rounded(out, score=6)


def load_two_outputs():
    return lambda x: np.stack([x[:, 0] + 2 * x[:, 1], np.abs(x[:, 2] - x[:, 3])], axis=1)


@query("SELECT uid, round(score_01 + 2 * score_02, 6) AS buy, round(abs(score_03 - score_04), 6) AS click FROM fx_score",
       ["fx_score"])
def score_multi_output(t):
    out = scoring.score_multi_output(t.fx_score, load_two_outputs, SCORES[:4], ["uid"], ["buy", "click"])
    return rounded(out, buy=6, click=6)


def calibrated(item: str) -> str:
    s = item_score(item).replace("score_01", "f1").replace("score_02", "f2")
    return f"{s} / ({s} + (1 - {s}) / 0.5)"


@query("SELECT c_custkey AS uid, " + ", ".join(f"round({calibrated(i)}, 6) AS score_{i}" for i in ITEMS)
       + """ FROM (SELECT c_custkey, coalesce(score_01, 0) AS f1, coalesce(score_02, -1) AS f2 FROM customer
  LEFT JOIN fx_score ON uid = c_custkey AND group_index < 8)""", ["fx_score"])
def scoring_job(t):
    """Dated people and feature tables in, calibrated dated scores of all items out."""
    root = f"{scratch_folder(t.spark)}/job-{uuid.uuid4().hex}"
    write_partition(t.customer.select(F.col("c_custkey").alias("uid")), f"{root}/people", "2024-01-08")
    write_partition(t.fx_score.where("group_index < 8").select("uid", "score_01", "score_02"),
                    f"{root}/features", "2024-01-07")
    scoring.run_scoring_job(
        t.spark, f"{root}/people", [(f"{root}/features", ["score_01", "score_02"])], f"{root}/scores",
        "2024-01-08", "2024-01-07", "uid", load_item_model, {"score_01": 0.0, "score_02": -1.0},
        ITEMS, "base", lambda s: E.calibrate_neg_sampling(s, 0.5))
    return rounded(read_partition(t.spark, f"{root}/scores", "2024-01-08", exp_mode="base"),
                   **{f"score_{i}": 6 for i in ITEMS})


# --- learnt from Spark models (rows only: random or iterative) ---------------------

TREES = {"maxIter": 3, "maxDepth": 3, "seed": 1}


ORDER_X = ["price", "cust", "prio"]
SHUFFLED = {c: ", ".join(f"r.{x}" if x == c else f"l.{x}" for x in ORDER_X) for c in ORDER_X}
ORDERS = """SELECT o_orderkey, o_totalprice AS price, CAST(o_custkey % 97 AS DOUBLE) AS cust,
    CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS prio FROM orders"""


@query(f"""WITH o AS ({ORDERS}), d AS (SELECT *, CAST(price + prio * 20000 > 200000 AS INT) AS y FROM o),
  l AS (SELECT y, {", ".join(ORDER_X)}, row_number() OVER (ORDER BY {hash_sql("o_orderkey || '|1-0a'")}, o_orderkey) AS pos FROM d),
  r AS (SELECT {", ".join(ORDER_X)}, row_number() OVER (ORDER BY {hash_sql("o_orderkey || '|1-0b'")}, o_orderkey) AS pos FROM d),
  v AS (SELECT '' AS feature, y, {", ".join(ORDER_X)} FROM d
    {" ".join(f"UNION ALL SELECT '{c}', y, {cols} FROM l JOIN r USING (pos)" for c, cols in SHUFFLED.items())}),
  s AS (SELECT feature, y, -1.0::DOUBLE + price * 0.00001::DOUBLE + cust * 0.002::DOUBLE + prio * 0.15::DOUBLE AS score FROM v),
  g AS (SELECT feature, score, sum(y) AS p, count(*) - sum(y) AS n FROM s GROUP BY feature, score),
  c AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY score) - n AS below FROM g),
  a AS (SELECT feature, sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS auc FROM c GROUP BY feature)
  SELECT feature, round((SELECT auc FROM a WHERE feature = '') - auc, 6) AS importance FROM a WHERE feature <> ''""")
def permutation_importance(t):
    """Shuffled-column importance of a closed-form model of the orders."""
    df = t.spark.sql(ORDERS.replace("FROM orders", "FROM {orders}"), orders=t.orders).withColumn(
        "y", (F.col("price") + F.col("prio") * 20000 > 200000).cast("int"))

    def score(rows):
        z = F.lit(-1.0)
        for c, v in zip(ORDER_X, (0.00001, 0.002, 0.15)):
            z = z + F.col(c) * v
        return rows.withColumn("score", z)

    return rounded(selection.permutation_importance(df, ["o_orderkey"], ORDER_X, "y", score), importance=6)


@query()
def null_importance(t):
    return selection.null_importance(t.fx_label, KEYS, X, "label", k=10, **TREES)


@query("""WITH i AS (SELECT p_brand AS feature, p_partkey AS k, p_retailprice / 1000 AS importance FROM part)
  SELECT feature, round(ln(1e-10 + avg(importance) / (1 + quantile_cont(importance, 0.75))), 6) AS gain_score
  FROM i GROUP BY feature""")
def null_score(t):
    """The final score on given importances: brands as features, parts as null runs."""
    null = t.part.select(F.col("p_brand").alias("feature"), (F.col("p_retailprice") / 1000).alias("importance"))
    actual = null.groupBy("feature").agg(F.avg("importance").alias("importance"))
    return rounded(selection.null_score(actual, null), gain_score=6)


@query()
def feature_importance(t):
    model = selection.boosted_trees(t.fx_label, X, "label", **TREES)
    return selection.model_importance(t.spark, model, X)


def fit_trees(train, test):
    from pyspark.ml.functions import vector_to_array

    model = selection.boosted_trees(train, X, "label", **TREES)
    rows = test.select("label", *X)
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1])


@query("""WITH g AS (SELECT score, sum(label) AS p, count(*) - sum(label) AS n FROM fx_label GROUP BY score),
  c AS (SELECT row_number() OVER w AS i, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS ps,
    sum(n) OVER () AS ns FROM g WINDOW w AS (ORDER BY score DESC)),
  r AS (SELECT i, tp / ps AS recall, fp / ns AS fall, tp / (tp + fp) AS precision FROM c),
  e AS (SELECT *, lag(recall, 1, 0) OVER o AS r0, lag(fall, 1, 0) OVER o AS f0,
    coalesce(lag(precision) OVER o, precision) AS p0 FROM r WINDOW o AS (ORDER BY i))
  SELECT 'roc_auc' AS metric, round(sum((fall - f0) * (recall + r0) / 2), 6) AS value FROM e
  UNION ALL SELECT 'pr_auc', round(sum((recall - r0) * (precision + p0) / 2), 6) FROM e""", ["fx_label"])
def model_areas(t):
    """ROC and precision-recall areas of the closed-form score, one curve point per distinct score."""
    areas = evaluate.model_areas(t.fx_label.select("label", "score"), "label", "score")
    out = t.spark.createDataFrame(sorted(areas.items()), "metric string, value double")
    return rounded(out, value=6)


@query()
def cv_auc(t):
    folds = split.stratified_kfold(t.fx_label.select(*KEYS, *X, "label"), KEYS, "label", 5, 2021)
    return evaluate.cv_auc(folds, "label", 5, fit_trees)


def people(t):
    return experiment(t).join(t.fx_score, "uid")


@query()
def uplift_tree(t):
    leaf = max(int(t.customer.count() * 0.03), 1)
    return effects.uplift_tree(experiment(t), "ite", "treated", "y", "cost", depth=4, min_leaf=leaf)


@query()
def uplift_tree_text(t):
    df = experiment(t).join(t.customer, F.col("uid") == F.col("c_custkey")).join(
        t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return effects.uplift_tree(df, "n_name", "treated", "y", depth=3, min_leaf=10)


@query()
def propensity(t):
    return effects.propensity(people(t), "uid", SCORES, "treatment", "control", ARMS, folds=5)


@query()
def x_learner(t):
    shares = {r["treatment"]: r["propensity"] for r in
              profile.arm_shares(t.fx_experiment, "treatment", "control").collect()}
    return effects.x_learner(people(t), "uid", SCORES, "treatment", "control", ARMS, "y", shares)


@query("""SELECT uid, round(p * a + (1 - p) * b, 6) AS ite FROM (SELECT uid, score_01 AS a, score_02 AS b,
  greatest(0.001::DOUBLE, least(0.999::DOUBLE, score_03 * 2)) AS p FROM fx_score)""", ["fx_score"])
def blend_effects(t):
    p = effects.clip_probability(F.col("score_03") * 2)
    return t.fx_score.select("uid", F.round(effects.blend_effects(
        p, F.col("score_01"), F.col("score_02")), 6).alias("ite"))


@query()
def dml_effect(t):
    return effects.dml_effect(people(t), "uid", SCORES, "treatment", "control", ARMS, "y", folds=5)
