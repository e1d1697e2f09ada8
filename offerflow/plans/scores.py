"""Evaluation of scored tables and treatment effects."""

from pyspark.sql import functions as F

from offerflow.operators import evaluate, ranking, uplift
from offerflow.plans.catalog import query
from offerflow.plans.ranks import RANKED
from offerflow.plans.rows import hash_sql
from offerflow.plans.views import SCORES

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K = ", ".join(KEYS)


def rounded(df, **decimals):
    return df.withColumns({c: F.round(c, d) for c, d in decimals.items()})


# --- evaluation --------------------------------------------------------------------

def auc_sql(source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys}round(sum(pos * (cum - neg / 2)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS auc
      FROM (SELECT *, sum(neg) OVER ({part} ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum FROM
      (SELECT {keys}score, sum(CAST(label > 0 AS INT)) AS pos, sum(CAST(label <= 0 AS INT)) AS neg
       FROM {source} GROUP BY {keys}score)) {tail}"""


@query(auc_sql("fx_label"), ["fx_label"])
def auc(t):
    return rounded(evaluate.auc(t.fx_label, "label", "score"), auc=6)


@query(auc_sql("fx_label", "item"), ["fx_label"])
def auc_by_item(t):
    return rounded(evaluate.auc(t.fx_label, "label", "score", ["item"]), auc=6)


@query(auc_sql("""(SELECT 'label_a' AS task, label, score FROM fx_label WHERE x1 >= 5 UNION ALL
    SELECT 'label_b', CAST(x3 > 0.05 AS INT), x1 FROM fx_label WHERE item <> 'O')""", "task"),
       ["fx_label"])
def masked_auc(t):
    df = t.fx_label.select(
        "score", "x1", F.when(F.col("x1") < 5, -100).otherwise(F.col("label")).alias("label_a"),
        F.when(F.col("item") == "O", -100).otherwise((F.col("x3") > 0.05).cast("int")).alias("label_b"))
    return rounded(evaluate.masked_auc(df, [("label_a", "score"), ("label_b", "x1")]), auc=6)


@query("""WITH c AS (SELECT unnest([0, 0.01, 0.02, 0.03, 0.3, 0.31, 0.9, 1]::DOUBLE[]) AS threshold),
  m AS (SELECT threshold, count(score) FILTER (score >= threshold) AS n,
    count(score) FILTER (score >= threshold AND label = 1) AS hits, count(*) FILTER (label = 1) AS pos
    FROM c, fx_label GROUP BY threshold)
  SELECT threshold, n AS count, CASE WHEN n = 0 THEN 0 ELSE hits / n END AS precision, hits / pos AS recall
  FROM m""", ["fx_label"])
def threshold_table_uneven(t):
    cuts = [0.0, 0.01, 0.02, 0.03, 0.3, 0.31, 0.9, 1.0]
    return evaluate.threshold_table(t.fx_label, "label", "score", cuts).select(
        "threshold", "count", "precision", "recall")


@query(f"""SELECT item, sum(CASE WHEN rn <= floor(n * 0.3::DOUBLE) + 1 AND label = 1 THEN 1 ELSE 0 END)
    / sum(label) AS recall FROM (SELECT item, label, row_number() OVER (PARTITION BY item
    ORDER BY score DESC, {K}) AS rn, count(*) OVER (PARTITION BY item) AS n FROM fx_label)
    GROUP BY item""", ["fx_label"])
def recall_at(t):
    return evaluate.recall_at(t.fx_label, "label", "score", 0.3, KEYS, ["item"])


@query(f"""SELECT sum(CASE WHEN rn <= floor(n * 0.2::DOUBLE) + 1 AND label = 1 THEN 1 ELSE 0 END)
    / sum(label) AS recall FROM (SELECT label, row_number() OVER (ORDER BY score DESC, {K}) AS rn,
    count(*) OVER () AS n FROM fx_label)""", ["fx_label"])
def recall_at_overall(t):
    return evaluate.recall_at(t.fx_label, "label", "score", 0.2, KEYS)


@query("""WITH c AS (SELECT CAST(round(i * 0.01::DOUBLE, 2) AS DOUBLE) AS threshold FROM range(101) r(i)),
  m AS (SELECT threshold, count(score) FILTER (score >= threshold) AS n,
    count(score) FILTER (score >= threshold AND label = 1) AS hits, count(*) FILTER (label = 1) AS pos
    FROM c, fx_label GROUP BY threshold),
  p AS (SELECT threshold, n, CASE WHEN n = 0 THEN 0 ELSE hits / n END AS precision,
    hits / pos AS recall FROM m)
  SELECT threshold, precision, recall, n AS count, recall AS recall_all,
    round(CASE WHEN precision + recall = 0 THEN NULL ELSE 2 * precision * recall / (precision + recall)
    END, 6) AS f1_all FROM p""", ["fx_label"])
def threshold_table(t):
    out = evaluate.threshold_table(t.fx_label, "label", "score", evaluate.thresholds())
    return rounded(out, f1_all=6)


@query(f"""SELECT idx AS item, count(*) AS n, round(avg(CAST(r <= 1 AS INT)), 6) AS recall_top_1,
    round(avg(CAST(r <= 3 AS INT)), 6) AS recall_top_3 FROM ({RANKED}) WHERE idx = uid % 5
    GROUP BY idx""", ["fx_score"])
def topk_recall(t):
    true = (F.col("uid") % 5).cast("int")
    df = t.fx_score.select(true.alias("item"), ranking.true_item_rank(SCORES, true).alias("rank"))
    return rounded(evaluate.topk_recall(df, "rank", [1, 3], ["item"]), recall_top_1=6, recall_top_3=6)


@query("""SELECT round(avg(-(label * ln(score) + (1 - label) * ln(1 - score))), 6) AS logloss
  FROM fx_label""", ["fx_label"])
def logloss(t):
    return rounded(evaluate.logloss(t.fx_label, "label", "score"), logloss=6)


@query("""SELECT round(avg(-(label * ln(score) + (1 - label) * ln(1 - score)) * w), 6) AS logloss
  FROM fx_label""", ["fx_label"])
def weighted_logloss(t):
    return rounded(evaluate.logloss(t.fx_label, "label", "score", "w"), logloss=6)


@query("""SELECT round(avg(0.5 * pow(1 - exp(-b), 2) * b), 6) AS focal_loss FROM (SELECT
  -(label * ln(score) + (1 - label) * ln(1 - score)) AS b FROM fx_label)""", ["fx_label"])
def focal_loss(t):
    return rounded(evaluate.focal_loss(t.fx_label, "label", "score", 0.5, 2.0), focal_loss=6)


@query("""WITH s AS (SELECT label, CAST(label = 1 AND item = 'O' AS INT) AS buy, score,
    0.05::DOUBLE + x4 * 5 AS s2 FROM fx_label),
  p AS (SELECT *, greatest(score, 1e-7::DOUBLE) AS p1, greatest(greatest(score, 1e-7::DOUBLE) * s2,
    1e-7::DOUBLE) AS p2 FROM s)
  SELECT round(avg(-(label * ln(p1) + (1 - label) * ln(1 - p1)))
    + avg(-(buy * ln(p2) + (1 - buy) * ln(1 - p2)))
    + 0.1 * avg(-(buy * ln(s2) + (1 - buy) * ln(1 - s2)) * label * least(1000, 1 / score)), 6)
    AS ips_loss FROM p""", ["fx_label"])
def ips_loss(t):
    df = t.fx_label.select(
        "label", ((F.col("label") == 1) & (F.col("item") == "O")).cast("int").alias("buy"), "score",
        (F.lit(0.05) + F.col("x4") * 5).alias("s2"))
    return rounded(evaluate.ips_loss(df, ["label", "buy"], ["score", "s2"]), ips_loss=6)


# --- treatment effects -------------------------------------------------------------

ARMS = [f"treatment_{i}" for i in range(1, 5)]

CURVE = """c AS (SELECT uid, idx, n, cum_tr, cum_ytr, cum_yct, idx - cum_tr AS ct FROM (
    SELECT uid, row_number() OVER w AS idx, count(*) OVER () AS n,
      sum(t) OVER (w ROWS UNBOUNDED PRECEDING) AS cum_tr,
      sum(y * t) OVER (w ROWS UNBOUNDED PRECEDING) AS cum_ytr,
      sum(y * (1 - t)) OVER (w ROWS UNBOUNDED PRECEDING) AS cum_yct
    FROM (SELECT *, CAST(treatment <> 'control' AS INT) AS t FROM fx_experiment)
    WINDOW w AS (ORDER BY ite DESC, uid))),
  l AS (SELECT *, CASE WHEN cum_tr > 0 AND ct > 0 THEN cum_ytr / cum_tr - cum_yct / ct END AS lift0,
      CASE WHEN ct > 0 THEN cum_ytr - cum_yct * cum_tr / ct END AS qini0 FROM c),
  f AS (SELECT min(idx) FILTER (lift0 IS NOT NULL) AS li, arg_min(lift0, idx) FILTER (lift0 IS NOT NULL) AS lv,
      min(idx) FILTER (qini0 IS NOT NULL) AS qi, arg_min(qini0, idx) FILTER (qini0 IS NOT NULL) AS qv FROM l),
  u AS (SELECT uid, idx, n, coalesce(lift0, lv * idx / li) AS lift, coalesce(qini0, qv * idx / qi) AS qini,
      cum_tr / idx AS treated_share FROM l, f)"""


def experiment(t):
    return t.fx_experiment.withColumn("treated", (F.col("treatment") != "control").cast("int"))


@query(f"WITH {CURVE} SELECT uid, idx, round(lift, 6) AS lift FROM u UNION ALL SELECT NULL, 0, 0",
       ["fx_experiment"])
def cum_lift(t):
    return rounded(uplift.cum_lift(experiment(t), "uid"), lift=6)


@query(f"""WITH {CURVE} SELECT uid, idx, round(lift * idx / abs(max(CASE WHEN idx = n THEN lift * idx END)
    OVER ()), 6) AS gain FROM u UNION ALL SELECT NULL, 0, 0""", ["fx_experiment"])
def cum_gain(t):
    return rounded(uplift.cum_gain(experiment(t), "uid", normalize=True), gain=6).drop("lift")


@query(f"WITH {CURVE} SELECT uid, idx, round(qini, 6) AS qini, round(treated_share, 6) AS treated_share FROM u "
       "UNION ALL SELECT NULL, 0, 0, 0", ["fx_experiment"])
def qini_curve(t):
    return rounded(uplift.qini_curve(experiment(t), "uid"), qini=6, treated_share=6)


def random_sql(seed: int, source: str, by: str = "") -> str:
    """Curves of ten hash orders over source(key columns, uid, y, t)."""
    keys = f"{by}, " if by else ""
    h = hash_sql(f"uid || '|' || o || '|{seed}'")
    return f"""rc AS (SELECT {keys}o, row_number() OVER w AS idx, sum(t) OVER (w ROWS UNBOUNDED PRECEDING) AS tr,
      sum(y * t) OVER (w ROWS UNBOUNDED PRECEDING) AS ytr, sum(y * (1 - t)) OVER (w ROWS UNBOUNDED PRECEDING) AS yct
      FROM {source}, range(1, 11) r(o) WINDOW w AS (PARTITION BY {keys}o ORDER BY {h}, uid)),
  rl AS (SELECT *, CASE WHEN idx > tr THEN ytr - yct * tr / (idx - tr) END AS q0 FROM rc),
  rf AS (SELECT {keys}o, min(idx) AS qi, arg_min(q0, idx) AS qv FROM rl WHERE q0 IS NOT NULL GROUP BY {keys}o),
  rq AS (SELECT {keys}o, idx, coalesce(q0, qv * idx / qi) AS q FROM rl JOIN rf USING ({keys}o))"""


@query(f"""WITH src AS (SELECT *, CAST(treatment <> 'control' AS INT) AS t FROM fx_experiment),
  {random_sql(42, 'src')} SELECT idx, round(avg(q), 6) AS random_qini FROM rq GROUP BY idx
  UNION ALL SELECT 0, 0""", ["fx_experiment"])
def random_baseline(t):
    return rounded(uplift.random_baseline(experiment(t), "uid"), random_qini=6)


@query(f"""WITH {CURVE} SELECT round(sum(lift * idx) / abs(max(CASE WHEN idx = n THEN lift * idx END))
    / (count(*) + 1), 6) AS auuc FROM u""", ["fx_experiment"])
def auuc_score(t):
    return rounded(uplift.auuc_score(experiment(t), "uid"), auuc=6)


@query(f"""WITH {CURVE}, src AS (SELECT *, CAST(treatment <> 'control' AS INT) AS t FROM fx_experiment),
  {random_sql(42, 'src')},
  rn AS (SELECT o, sum(q) / arg_max(q, idx) AS s FROM rq GROUP BY o)
  SELECT round((sum(qini) / arg_max(qini, idx) - (SELECT sum(s) / 10 FROM rn)) / (count(*) + 1), 6)
    AS qini_score FROM u""", ["fx_experiment"])
def qini_score(t):
    return rounded(uplift.qini_score(experiment(t), "uid"), qini_score=6)


def decile_sql(source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    agg = ", ".join(
        f"count(*) FILTER ({on}) AS {n}_num, " + ", ".join(
            f"round(coalesce(sum({c}::DOUBLE) FILTER ({on}), 0), 6) AS {n}_{a}"
            for a, c in (("y", "y"), ("effect", "ite"), ("cost", "cost")))
        for n, on in (("t", "t = 1"), ("c", "t = 0")))
    return f"""d AS (SELECT {keys}bin, {agg} FROM (SELECT *, CAST(floor((rn - 1) / size) AS INT) AS bin FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys}t ORDER BY ite DESC, uid) AS rn,
        floor(count(*) OVER (PARTITION BY {keys}t) / 10) AS size FROM {source})) WHERE bin < 10
      GROUP BY {keys}bin)"""


SRC = "WITH src AS (SELECT *, CAST(treatment <> 'control' AS INT) AS t FROM fx_experiment)"
AREA = """lf AS (SELECT {k}bin, c_num * t_y / t_num - c_y AS true_lift, c_num * t_effect / t_num
    AS predicted_lift, t_cost AS total_cost, t_num AS n_treated, c_num AS n_control FROM d),
  cv AS (SELECT {k}bin, (bin + 1) / 10 AS population_share,
    sum(true_lift) OVER (w ROWS UNBOUNDED PRECEDING) / sum(true_lift) OVER ({p}) AS lift_share,
    sum(total_cost) OVER (w ROWS UNBOUNDED PRECEDING) / sum(total_cost) OVER ({p}) AS cost_share
    FROM lf WINDOW w AS ({p} ORDER BY bin)),
  ar AS (SELECT {k}sum(lift_share * (cost_share - pc)) AS aucc, sum(lift_share * (population_share - pp)) AS auuc
    FROM (SELECT *, coalesce(lag(cost_share) OVER (w), 0) AS pc, coalesce(lag(population_share) OVER (w), 0) AS pp
      FROM cv WINDOW w AS ({p} ORDER BY bin)) {g})"""
TOTAL = AREA.format(k="", p="", g="")


def deciles(t):
    return uplift.uplift_deciles(experiment(t), "uid")


@query(f"{SRC}, {decile_sql('src')} SELECT * FROM d", ["fx_experiment"])
def uplift_deciles(t):
    return rounded(deciles(t), **{f"{s}_{c}": 6 for s in "tc" for c in ("y", "effect", "cost")})


MATCH_H = hash_sql("uid || '|42'")


@query(f"""{SRC}, b AS (SELECT *, CAST(floor((rn - 1) / size) AS INT) AS bin,
      CASE WHEN ite > 0.5 THEN 'treatment_1' WHEN ite > 0.2 THEN 'treatment_2' ELSE 'treatment_3' END AS pred
      FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY ite DESC, uid) AS rn,
      floor(count(*) OVER (PARTITION BY t) / 10) AS size FROM src)),
  tr AS (SELECT bin, pred, y FROM b WHERE bin < 10 AND t = 1 AND pred = treatment),
  q AS (SELECT bin, pred, count(*) AS q FROM tr GROUP BY bin, pred),
  ct AS (SELECT bin, pred, y, row_number() OVER (PARTITION BY bin, pred ORDER BY {MATCH_H}, uid) AS r
    FROM b WHERE bin < 10 AND t = 0)
  SELECT bin, sum(tn)::BIGINT AS t_num, sum(ty)::DOUBLE AS t_y, sum(cn)::BIGINT AS c_num, sum(cy)::DOUBLE AS c_y
  FROM (SELECT bin, 1 AS tn, y AS ty, 0 AS cn, 0 AS cy FROM tr UNION ALL
    SELECT bin, 0, 0, 1, y FROM ct JOIN q USING (bin, pred) WHERE r <= q) GROUP BY bin""",
       ["fx_experiment"])
def uplift_deciles_matched(t):
    pred = (F.when(F.col("ite") > 0.5, "treatment_1").when(F.col("ite") > 0.2, "treatment_2")
            .otherwise("treatment_3"))
    out = uplift.uplift_deciles(experiment(t).withColumn("pred", pred), "uid", predicted="pred",
                                actual="treatment", match_control=True)
    return out.select("bin", "t_num", "t_y", "c_num", "c_y")


@query(f"""{SRC}, {decile_sql('src')}, {TOTAL} SELECT bin, round(true_lift, 4) AS true_lift,
  round(predicted_lift, 4) AS predicted_lift, total_cost, n_treated, n_control FROM lf""",
       ["fx_experiment"])
def decile_lift(t):
    return rounded(uplift.decile_lift(deciles(t)), true_lift=4, predicted_lift=4, total_cost=6)


@query(f"""{SRC}, {decile_sql('src')}, {TOTAL} SELECT bin, population_share, round(lift_share, 6)
  AS lift_share, round(cost_share, 6) AS cost_share FROM cv""", ["fx_experiment"])
def decile_curve(t):
    return rounded(uplift.decile_curve(uplift.decile_lift(deciles(t))), lift_share=6, cost_share=6)


@query(f"""{SRC}, {decile_sql('src')}, {TOTAL} SELECT round(aucc, 6) AS aucc, round(auuc, 6) AS auuc
  FROM ar""", ["fx_experiment"])
def aucc_auuc(t):
    curve = uplift.decile_curve(uplift.decile_lift(deciles(t)))
    return rounded(uplift.aucc_auuc(curve), aucc=6, auuc=6)


VERSUS = """WITH src AS (SELECT uid, y, cost, ite, CAST(treatment <> 'control' AS INT) AS t,
    treatment AS versus FROM fx_experiment WHERE treatment <> 'control' UNION ALL
  SELECT uid, y, cost, ite, 0, versus FROM fx_experiment,
    (SELECT unnest(['treatment_1', 'treatment_2', 'treatment_3', 'treatment_4']) AS versus)
    WHERE treatment = 'control')"""


ARMS_SQL = f"""{VERSUS}, {decile_sql('src', 'versus')},
  {AREA.format(k="versus, ", p="PARTITION BY versus", g="GROUP BY versus")},
  {random_sql(42, 'src', 'versus')},
  rs AS (SELECT versus, sum(s) / 10 AS r FROM (SELECT versus, o, sum(q) / arg_max(q, idx) AS s FROM rq
    GROUP BY versus, o) GROUP BY versus),
  mc AS (SELECT versus, row_number() OVER w AS idx, sum(t) OVER (w ROWS UNBOUNDED PRECEDING) AS tr,
    sum(y * t) OVER (w ROWS UNBOUNDED PRECEDING) AS ytr, sum(y * (1 - t)) OVER (w ROWS UNBOUNDED PRECEDING) AS yct
    FROM src WINDOW w AS (PARTITION BY versus ORDER BY ite DESC, uid)),
  ml AS (SELECT *, CASE WHEN idx > tr THEN ytr - yct * tr / (idx - tr) END AS q0 FROM mc),
  mf AS (SELECT versus, min(idx) AS qi, arg_min(q0, idx) AS qv FROM ml WHERE q0 IS NOT NULL GROUP BY versus),
  mq AS (SELECT versus, idx, coalesce(q0, qv * idx / qi) AS q FROM ml JOIN mf USING (versus)),
  ms AS (SELECT versus, sum(q) / arg_max(q, idx) AS m, count(*) AS n FROM mq GROUP BY versus)
  SELECT versus AS arm, round((m - r) / (n + 1), 6) AS qini_score, round(aucc, 6) AS aucc,
    round(auuc, 6) AS auuc, (SELECT sum(t)::BIGINT FROM src s WHERE s.versus = ms.versus) AS n_treated
  FROM ms JOIN rs USING (versus) JOIN ar USING (versus)"""


def _arms(t):
    return uplift.evaluate_arms(t.fx_experiment, "uid", "treatment", "control", ARMS,
                                {a: "ite" for a in ARMS})


@query(ARMS_SQL, ["fx_experiment"])
def evaluate_arms(t):
    return rounded(_arms(t), qini_score=6, aucc=6, auuc=6)


@query(f"""WITH a AS ({ARMS_SQL.replace(', 6)', ', 16)')}) SELECT arm, round(qini_score, 6) AS qini_score,
    round(aucc, 6) AS aucc, round(auuc, 6) AS auuc, n_treated FROM a UNION ALL SELECT 'mean',
    round(avg(qini_score), 6), round(avg(aucc), 6), round(avg(auuc), 6), sum(n_treated)::BIGINT FROM a""",
       ["fx_experiment"])
def evaluate_arms_mean(t):
    return rounded(uplift.mean_over_arms(_arms(t)), qini_score=6, aucc=6, auuc=6)


PRED = """CASE WHEN ite > 0.6 THEN 'treatment_1' WHEN ite > 0.3 THEN 'treatment_3'
  WHEN ite > 0 THEN 'treatment_4' ELSE 'treatment_9' END"""


@query(f"""WITH p AS (SELECT *, {PRED} AS pred FROM fx_experiment),
  m AS (SELECT pred, avg(y) AS mean FROM p WHERE pred = treatment GROUP BY pred),
  n AS (SELECT pred, count(*) AS n FROM p GROUP BY pred)
  SELECT round(sum(mean * n) / sum(n), 6) AS policy_mean, round((SELECT avg(y) FROM p), 6) AS overall_mean,
    round((sum(mean * n) / sum(n) - (SELECT avg(y) FROM p)) / (SELECT avg(y) FROM p), 6) AS pmg
  FROM m JOIN n USING (pred)""", ["fx_experiment"])
def pmg(t):
    df = t.fx_experiment.withColumn("pred", F.expr(PRED))
    return rounded(uplift.pmg(df, "treatment", "pred", "y"), policy_mean=6, overall_mean=6, pmg=6)


@query("""SELECT uid, CASE WHEN greatest(a, b, c) <= 0 THEN 0 WHEN a = greatest(a, b, c) THEN 1
  WHEN b = greatest(a, b, c) THEN 2 ELSE 3 END AS arm FROM (SELECT uid, score_01 - 0.2::DOUBLE AS a,
  score_02 - 0.2::DOUBLE AS b, score_03 - 0.2::DOUBLE AS c FROM fx_score)""", ["fx_score"])
def best_arm(t):
    df = t.fx_score.select("uid", *[(F.col(f"score_0{i}") - 0.2).alias(c)
                                    for i, c in ((1, "a"), (2, "b"), (3, "c"))])
    return df.select("uid", uplift.best_arm(["a", "b", "c"]).alias("arm"))
