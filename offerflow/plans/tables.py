"""Sources, joins and profiles."""

from pyspark.sql import functions as F

from offerflow.operators import joins, profile
from offerflow.plans.catalog import query
from offerflow.plans.views import SCORES
from offerflow.session import scratch_folder
from offerflow.sources import files, partitions

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
X = ["x1", "x2", "x3", "x4"]


# --- sources -----------------------------------------------------------------------

def dated_orders(t, folder: str) -> str:
    """All orders as a monthly dated table with an exp_mode level, in the scratch folder."""
    path = f"{scratch_folder(t.spark)}/{folder}"
    df = t.orders.select(
        "o_orderkey", "o_custkey", "o_totalprice",
        F.date_format("o_orderdate", "yyyy").alias("year"),
        F.date_format("o_orderdate", "MM").alias("month"), F.lit("01").alias("day"),
        F.col("o_orderstatus").alias("exp_mode"))
    # rebalance: one file per small partition, several for a hot one
    (df.hint("rebalance", "year", "month", "exp_mode").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy("year", "month", "day", "exp_mode").parquet(path))
    return path


MONTH = """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
  WHERE date_trunc('month', o_orderdate) = DATE '1995-03-01' AND o_orderstatus = 'F'"""


@query(MONTH)
def read_partition(t):
    path = dated_orders(t, "dated_orders")
    return partitions.read_partition(t.spark, path, "1995-03-01", exp_mode="F")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def write_partition(t):
    path = f"{scratch_folder(t.spark)}/written_orders"
    day = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    for _ in range(2):  # the second write replaces the first
        partitions.write_partition(day, path, "1995-03-03", role="0", exp_mode="O")
    return partitions.read_partition(t.spark, path, "1995-03-03", role="0", exp_mode="O")


@query("""SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus AS exp_mode FROM orders
  WHERE o_orderstatus <> 'O'""")
def write_partition_empty(t):
    path = f"{scratch_folder(t.spark)}/emptied_orders"
    for mode in ("F", "O", "P"):
        day = t.orders.where(F.col("o_orderstatus") == mode).select("o_orderkey", "o_custkey", "o_totalprice")
        partitions.write_partition(day, path, "1995-03-03", exp_mode=mode)
    nothing = t.orders.select("o_orderkey", "o_custkey", "o_totalprice").where("false")
    partitions.write_partition(nothing, path, "1995-03-03", exp_mode="O")
    return partitions.read_partition(t.spark, path, "1995-03-03")


@query("""SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus AS exp_mode FROM orders
  WHERE date_trunc('month', o_orderdate) = DATE '1995-03-01'""")
def carry_forward_all_modes(t):
    path = dated_orders(t, "carried_modes")
    partitions.carry_forward(t.spark, path, "1995-03-01", "1999-01-01")
    return partitions.read_partition(t.spark, path, "1999-01-01")


@query(MONTH)
def carry_forward(t):
    path = dated_orders(t, "carried_orders")
    partitions.carry_forward(t.spark, path, "1995-03-01", "1999-01-01", exp_mode="F")
    return partitions.read_partition(t.spark, path, "1999-01-01", exp_mode="F")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def tsv_round_trip(t):
    path = f"{scratch_folder(t.spark)}/nation_tsv"
    df = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    files.export_tsv(df, path, header=True, single_file=True)
    return files.read_tsv(t.spark, path, df.schema)


@query("""SELECT o_orderkey AS sample_id, o_totalprice AS amount FROM orders
  WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_totalprice FROM orders
  WHERE o_orderstatus <> 'F'""")
def read_samples(t):
    root = f"{scratch_folder(t.spark)}/samples"
    paths = []
    for status in ("F", "O", "P"):
        week = t.orders.where(F.col("o_orderstatus") == status)
        cols = [F.col("o_orderkey").alias("sample_id"), F.col("o_totalprice").alias("amount"),
                F.col("o_custkey").alias("uid")]
        path = f"{root}_{status}"
        week.select(*(cols if status == "F" else cols[::-1])).write.mode("overwrite").parquet(path)
        paths.append(path)
    return files.read_samples(t.spark, paths, ["sample_id", "amount"])


@query(f"SELECT {', '.join(KEYS)}, x2, label FROM fx_label", ["fx_label"])
def select_features(t):
    return files.select_features(t.fx_label, KEYS, ["x2", "label"])


# --- joins -------------------------------------------------------------------------

@query("""SELECT c.c_custkey AS uid, l.o_totalprice, l.o_orderpriority, s.score_01
  FROM customer c LEFT JOIN (SELECT o_custkey, o_totalprice, o_orderpriority,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders) l ON l.o_custkey = c.c_custkey AND l.rn = 1
  LEFT JOIN fx_score s ON s.uid = c.c_custkey""", ["fx_score"])
def assemble_features(t):
    base = t.customer.select(F.col("c_custkey").alias("uid"))
    orders = t.orders.select(F.col("o_custkey").alias("uid"), "o_orderdate", "o_orderkey",
                             "o_totalprice", "o_orderpriority")
    return joins.assemble_features(
        base, [(orders, ["-o_orderdate", "-o_orderkey"]),
               (t.fx_score.select("uid", "score_01"), [])], ["uid"])


@query("""SELECT c_custkey AS uid, a.rule_01, a.rule_02 & b.rule_02 AS rule_02,
  s.score_01 * u.score_01 AS score_01, s.score_02 * u.score_02 AS score_02
  FROM customer LEFT JOIN fx_rule a ON a.uid = c_custkey
  LEFT JOIN (SELECT uid, rule_02 FROM fx_rule WHERE rule_01 = 1) b ON b.uid = c_custkey
  LEFT JOIN fx_score s ON s.uid = c_custkey
  LEFT JOIN fx_score u ON u.uid = c_custkey AND u.group_index < 8""", ["fx_rule", "fx_score"])
def join_rules_scores(t):
    ids = t.customer.select(F.col("c_custkey").alias("uid"))
    rules = [t.fx_rule.select("uid", "rule_01", "rule_02"),
             t.fx_rule.where("rule_01 = 1").select("uid", "rule_02")]
    scores = [t.fx_score.select("uid", "score_01", "score_02"),
              t.fx_score.where("group_index < 8").select("uid", "score_01", "score_02")]
    return joins.join_rules_scores(ids, rules, scores)


@query("""SELECT a.uid, a.score_01, a.score_02, b.score_02 AS score_02_2, b.score_03
  FROM fx_score a JOIN fx_score b ON a.uid = b.uid AND b.group_index >= 3""", ["fx_score"])
def union_feature_groups(t):
    a = t.fx_score.select("uid", "score_01", "score_02")
    b = t.fx_score.where("group_index >= 3").select("uid", "score_02", "score_03")
    return joins.union_feature_groups(a, b, ["uid"])


@query("""WITH k AS (SELECT uid FROM fx_score UNION SELECT uid FROM fx_rule
    UNION SELECT DISTINCT uid FROM fx_positive)
  SELECT n AS table_name, CAST(held AS BIGINT) AS keys_held,
    (SELECT count(*) FROM k) - CAST(held AS BIGINT) AS keys_missing FROM (
  SELECT 'score' AS n, (SELECT count(DISTINCT uid) FROM fx_score) AS held
  UNION ALL SELECT 'rule', (SELECT count(DISTINCT uid) FROM fx_rule)
  UNION ALL SELECT 'positive', (SELECT count(DISTINCT uid) FROM fx_positive))""",
       ["fx_score", "fx_rule", "fx_positive"])
def check_alignment(t):
    return joins.check_alignment(
        {"score": t.fx_score, "rule": t.fx_rule, "positive": t.fx_positive}, ["uid"])


@query("""SELECT s.uid, s.score_01, e.y AS label FROM fx_score s JOIN fx_experiment e
  ON e.uid = s.uid""", ["fx_score", "fx_experiment"])
def join_online_scores(t):
    labels = t.fx_experiment.select("uid", F.col("y").alias("label"))
    return joins.join_online_scores(t.fx_score.select("uid", "score_01"), labels, ["uid"])


@query("""SELECT c_custkey AS uid, n_nationkey AS item, CAST(c_nationkey = n_nationkey AS INT)
  AS own FROM customer, nation""")
def expand_items(t):
    users = t.customer.select(F.col("c_custkey").alias("uid"), "c_nationkey")
    out = joins.expand_items(users, t.nation.select(F.col("n_nationkey").alias("item")))
    return out.select("uid", "item",
                      (F.col("c_nationkey") == F.col("item")).cast("int").alias("own"))


@query("SELECT c_custkey AS uid, s_suppkey AS item FROM customer, supplier")
def expand_items_blocks(t):
    """The same with a longer item list, in blocks of 16."""
    users = t.customer.select(F.col("c_custkey").alias("uid"))
    items = t.supplier.select(F.col("s_suppkey").alias("item"))
    return joins.expand_items(users, items, chunk=16)


@query("""SELECT DISTINCT uid FROM fx_positive WHERE uid NOT IN
  (SELECT uid FROM fx_positive WHERE dt < DATE '2024-01-02')""", ["fx_positive"])
def anti_split(t):
    train = t.fx_positive.where("dt < DATE '2024-01-02'").select("uid")
    return joins.anti_split(t.fx_positive.select("uid").distinct(), train, ["uid"])


@query("""SELECT count(*) AS base_rows, count(s.uid) AS matched,
  count(s.uid) / count(*) AS match_rate FROM customer LEFT JOIN
  (SELECT DISTINCT o_custkey AS uid FROM orders WHERE o_orderstatus = 'P') s
  ON s.uid = c_custkey""")
def match_rate(t):
    base = t.customer.select(F.col("c_custkey").alias("uid"))
    other = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("uid"))
    return joins.match_rate(base, other, ["uid"])


# --- profiles ----------------------------------------------------------------------

DESCRIBE = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean,"
    f" round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max,"
    f" avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END) * 100 AS miss_percent,"
    f" quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50,"
    f" quantile_cont({c}, 0.75) AS p75 FROM src" for c in ["x1", "x2", "x3", "x4"])


@query("WITH src AS (SELECT x1, x2, CASE WHEN x1 > 10 THEN x3 END AS x3, x4 FROM fx_label) "
       + DESCRIBE, ["fx_label"])
def describe_features(t):
    src = t.fx_label.select("x1", "x2", F.when(F.col("x1") > 10, F.col("x3")).alias("x3"), "x4")
    out = profile.describe_features(src, ["x1", "x2", "x3", "x4"])
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("WITH src AS (SELECT x1, x2, CASE WHEN x1 > 10 THEN x3 END AS x3, x4 FROM fx_label) "
       + DESCRIBE, ["fx_label"])
def describe_features_nan(t):
    src = t.fx_label.select("x1", "x2", F.when(F.col("x1") > 10, F.col("x3")).otherwise(F.lit(float("nan"))).alias("x3"), "x4")
    out = profile.describe_features(src, ["x1", "x2", "x3", "x4"])
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("SELECT uid, score_01 FROM fx_score", ["fx_score"])
def drop_constant(t):
    df = t.fx_score.select("uid", "score_01", F.lit(3.0).alias("flat"))
    return profile.drop_constant(df, ["score_01", "flat"])


@query("""SELECT item, label, count(*) AS n FROM fx_label GROUP BY item, label""", ["fx_label"])
def label_counts(t):
    return profile.label_counts(t.fx_label, ["item", "label"])


@query("""SELECT item, sum(CASE WHEN label = 0 THEN w END) AS label_0,
  sum(CASE WHEN label = 1 THEN w END) AS label_1 FROM fx_label GROUP BY item""", ["fx_label"])
def crosstab(t):
    return profile.crosstab(t.fx_label, "item", "label", [0, 1], "w")


@query("""SELECT uid, obs_dt, max(CAST(item = 'click' AS INT)) AS label_click,
  max(CAST(item = 'purchase' AS INT)) AS label_purchase FROM fx_positive GROUP BY uid, obs_dt""",
       ["fx_positive"])
def max_merge_labels(t):
    df = t.fx_positive.withColumns({
        "label_click": (F.col("item") == "click").cast("int"),
        "label_purchase": (F.col("item") == "purchase").cast("int")})
    return profile.max_merge_labels(df, ["uid", "obs_dt"], ["label_click", "label_purchase"])


@query("""SELECT uid, obs_dt, max(CASE WHEN item = 'click' THEN label ELSE 0 END) AS label_click,
  max(CASE WHEN item = 'view' THEN label ELSE 0 END) AS label_view
  FROM (SELECT *, CAST(event_id % 2 AS INT) AS label FROM fx_positive) GROUP BY uid, obs_dt""",
       ["fx_positive"])
def item_labels(t):
    df = t.fx_positive.withColumn("label", (F.col("event_id") % 2).cast("int"))
    return profile.item_labels(df, ["uid", "obs_dt"], "item", ["click", "view"], "label")


@query("SELECT DISTINCT uid, obs_dt, item, 1 AS label FROM fx_positive", ["fx_positive"])
def distinct_positives(t):
    return profile.distinct_positives(t.fx_positive, ["uid", "obs_dt", "item"])


@query("""SELECT group_index, count(*) AS n_users, """
       + ", ".join(f"round(avg({s}), 6) AS {s}_mean" for s in SCORES)
       + " FROM fx_score GROUP BY group_index", ["fx_score"])
def group_summary(t):
    out = profile.group_summary(t.fx_score, ["group_index"], SCORES)
    return out.withColumns({f"{s}_mean": F.round(f"{s}_mean", 6) for s in SCORES})


@query("""WITH m AS (SELECT c_nationkey, CAST(c_custkey % 3 AS INT) AS tier,
    max(floor(c_acctbal / 100) / 100) AS amount FROM customer GROUP BY 1, 2),
  p AS (SELECT c_nationkey, max(CASE WHEN tier = 0 THEN CAST(round(amount * 100) AS INT) END) AS lo,
    max(CASE WHEN tier = 1 THEN CAST(round(amount * 100) AS INT) END) AS mi,
    max(CASE WHEN tier = 2 THEN CAST(round(amount * 100) AS INT) END) AS hi FROM m GROUP BY 1)
  SELECT c_nationkey, '{' || concat_ws(',', CASE WHEN lo IS NOT NULL THEN '"low":' || lo END,
    CASE WHEN mi IS NOT NULL THEN '"mid":' || mi END,
    CASE WHEN hi IS NOT NULL THEN '"high":' || hi END) || '}' AS field FROM p""")
def tier_map(t):
    m = t.customer.groupBy("c_nationkey", (F.col("c_custkey") % 3).cast("int").alias("tier")).agg(
        F.max(F.floor(F.col("c_acctbal") / 100) / 100).alias("amount"))
    return profile.tier_map(m, ["c_nationkey"], "tier", "amount", {0: "low", 1: "mid", 2: "high"})


@query("""WITH a AS (SELECT treatment, count(*) AS n, avg(y) AS rate FROM fx_experiment
    WHERE treatment <> 'control' GROUP BY treatment)
  SELECT round(sum(rate * n) / sum(n), 6) AS rate_mean FROM a""", ["fx_experiment"])
def weighted_mean_over_arms(t):
    arms = t.fx_experiment.where("treatment <> 'control'").groupBy("treatment").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"))
    return profile.weighted_mean_over_arms(arms, "rate", "n").withColumn(
        "rate_mean", F.round("rate_mean", 6))


@query("""SELECT item, count(*) AS n, round(-ln(count(*) / (SELECT count(*) FROM fx_positive)), 6)
  AS log_freq FROM fx_positive GROUP BY item""", ["fx_positive"])
def item_log_freq(t):
    return profile.item_log_freq(t.fx_positive, "item").withColumn(
        "log_freq", F.round("log_freq", 6))


@query("""SELECT treatment, count(*) AS n, count(*) / (count(*) +
  (SELECT count(*) FROM fx_experiment WHERE treatment = 'control')) AS propensity
  FROM fx_experiment WHERE treatment <> 'control' GROUP BY treatment""", ["fx_experiment"])
def arm_shares(t):
    return profile.arm_shares(t.fx_experiment, "treatment", "control")


@query("""WITH v AS (SELECT CASE WHEN x2 < 30000 OR x2 > 60000 THEN x2 END AS x FROM fx_label),
  s AS (SELECT min(x) AS lo, max(x) AS hi, avg(x) AS mu, stddev_pop(x) AS sd FROM v),
  c AS (SELECT CAST(least(floor((x - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM v, s WHERE x IS NOT NULL GROUP BY 1),
  b AS (SELECT CAST(unnest(range(20)) AS INT) AS bin)
  SELECT bin, round(lo + bin * ((hi - lo) / 20), 6) AS left_edge, coalesce(n, 0) AS n, round(mu, 4) AS mu, round(sd, 4) AS sigma
  FROM b LEFT JOIN c USING (bin), s""", ["fx_label"])
def plot_histogram(t):
    """Values with a gap, so that some bins are empty."""
    gap = t.fx_label.select(F.when((F.col("x2") < 30000) | (F.col("x2") > 60000), F.col("x2")).alias("x"))
    out = profile.plot_data(gap, "x", "hist", bins=20)
    return out.withColumns({"left_edge": F.round("left_edge", 6), "mu": F.round("mu", 4),
                            "sigma": F.round("sigma", 4)})


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, quantile_cont({c}, 0) AS low, quantile_cont({c}, 0.25) AS q1,"
    f" quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3,"
    f" quantile_cont({c}, 1) AS high FROM fx_label" for c in X), ["fx_label"])
def plot_box(t):
    return profile.box_summary(t.fx_label, X)


@query("""SELECT x1, count(*) AS n, sum(CAST(label = 1 AS INT))::BIGINT AS n_pos FROM fx_label
  GROUP BY x1""", ["fx_label"])
def plot_counts(t):
    return profile.plot_data(t.fx_label, "x1", "count", "label", 1)


@query("SELECT x1, x3, count(*) AS n FROM fx_label GROUP BY x1, x3", ["fx_label"])
def plot_scatter(t):
    return profile.plot_data(t.fx_label, "x1", "scatter", "x3")


@query(" UNION ALL ".join(f"SELECT '{s}' AS arm, sum(CAST({s} > 0 AS INT))::BIGINT AS n_positive"
                          " FROM fx_score" for s in SCORES), ["fx_score"])
def positive_effect_counts(t):
    return profile.positive_effect_counts(t.fx_score, SCORES)
