"""Ranking of items and users, and the flagship query."""

from pyspark.sql import functions as F

from offerflow.operators import profile, ranking
from offerflow.operators.ordered import running
from offerflow.functions import expr as E
from offerflow.plans.catalog import query
from offerflow.plans.rows import hash_sql
from offerflow.plans.views import CODES, ITEMS, RATIOS, SCORES

RULES = ["rule_01", "rule_02", "rule_03", "rule_04"]

LONG = " UNION ALL ".join(
    f"SELECT uid, {i} AS idx, '{ITEMS[i]}' AS item, {s} AS score FROM fx_score"
    for i, s in enumerate(SCORES))
RANKED = (f"SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, idx DESC) AS r"
          f" FROM ({LONG})")


@query(f"""WITH ranked AS ({RANKED}), best AS (
    SELECT b.uid, CASE WHEN b.score < 0.25 AND b.uid % 2 = 0 THEN 'none' ELSE b.item END AS item
    FROM ranked b JOIN fx_rule q ON q.uid = b.uid WHERE b.r = 1
    AND greatest(rule_01, rule_02, rule_03, rule_04) IS DISTINCT FROM 0)
  SELECT e.item, e.code AS item_code, e.ratio AS expected_ratio, count(b.uid) AS n_users,
    round(count(b.uid) / (SELECT count(*) FROM best), 3) AS share
  FROM (VALUES {", ".join(f"('{i}', {c}, {r}::DOUBLE)" for i, c, r in
        zip([*ITEMS, "none"], [*CODES, 97], [*RATIOS, 0.0]))}) e(item, code, ratio)
  LEFT JOIN best b ON b.item = e.item GROUP BY e.item, e.code, e.ratio""",
       ["fx_score", "fx_rule"])
def top_item_traffic(t):
    users = t.fx_score.join(t.fx_rule, "uid").where(
        ~E.rule_none(RULES).eqNullSafe(F.lit(0)))
    item, _ = ranking.top_item(SCORES, ITEMS, CODES, threshold=0.25, flag=F.col("uid") % 2,
                               fallback=("none", 97))
    return profile.traffic_report(users.select("uid", item.alias("item")), "item",
                                  [*ITEMS, "none"], [*CODES, 97], [*RATIOS, 0.0])


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
  WHERE rn = 1""")
def dedup_latest(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return ranking.dedup_latest(rows, ["o_custkey"], ["-o_orderdate", "-o_orderkey"]).drop(
        "o_orderdate")


OWN = "CASE item " + " ".join(f"WHEN '{i}' THEN {s}" for i, s in zip(ITEMS[:4], SCORES)) + " END"


@query(f"""SELECT uid, item, CASE WHEN item = 'eee' THEN -1 ELSE row_number() OVER (
    PARTITION BY item ORDER BY {OWN} DESC NULLS LAST, uid) END AS item_score_rank
  FROM (SELECT s.*, r.item FROM fx_score s JOIN ({RANKED}) r ON r.uid = s.uid AND r.r = 1)""",
       ["fx_score"])
def rank_in_item(t):
    item, _ = ranking.top_item(SCORES, ITEMS, CODES)
    df = t.fx_score.withColumn("item", item)
    out = ranking.rank_in_item(df, "item", dict(zip(ITEMS[:4], SCORES)))
    return out.select("uid", "item", "item_score_rank")


@query(f"""SELECT uid, string_agg(item, '-' ORDER BY r) AS items,
  string_agg(printf('%.6f', score), '-' ORDER BY r) AS scores FROM ({RANKED}) GROUP BY uid""",
       ["fx_score"])
def rank_items(t):
    names = ranking.item_names(ITEMS)
    ranked = t.fx_score.select("uid", names.alias("names"), ranking.rank_items(SCORES).alias("r"))
    return ranked.select(
        "uid",
        F.array_join(F.transform("r", lambda x: F.get(F.col("names"), x["idx"])), "-").alias("items"),
        F.array_join(F.transform("r", lambda x: F.format_string("%.6f", x["score"])), "-").alias("scores"))


SKUS = {"cashback": ["a1", "a2"], "voucher": ["b1", "b2", "b3", "b4"], "points": ["c1"], "trial": ["d1"],
        "upgrade": ["e1", "e2", "e3"]}
SKU_CASE = "CASE item " + " ".join(
    f"WHEN '{i}' THEN list_extract([{', '.join(repr(s) for s in skus)}], 1 + "
    + hash_sql(f"uid || '|{i}|7'") + f" % {len(skus)})" for i, skus in SKUS.items()) + " END"


@query(f"""SELECT uid, string_agg({SKU_CASE}, '-' ORDER BY r) AS seq_item_sku,
  string_agg(printf('%.10f', score), '-' ORDER BY r) AS seq_item_score
  FROM ({RANKED}) GROUP BY uid""", ["fx_score"])
def item_sequence(t):
    return ranking.item_sequence(t.fx_score, SCORES, SKUS, seed=7)


@query(f"""SELECT uid, CASE WHEN score < 0.4 AND group_index % 2 = 0 THEN 'none' ELSE item END AS item,
  CASE WHEN score < 0.4 AND group_index % 2 = 0 THEN 999 ELSE
    list_extract([{", ".join(map(str, CODES))}], idx + 1) END AS item_id
  FROM ({RANKED}) JOIN (SELECT uid, group_index FROM fx_score) USING (uid) WHERE r = 1""",
       ["fx_score"])
def top_item(t):
    item, code = ranking.top_item(SCORES, ITEMS, CODES, 0.4, F.col("group_index") % 2)
    return t.fx_score.select("uid", item.alias("item"), code.alias("item_id"))


@query(f"""SELECT uid, string_agg(item, '-' ORDER BY (item <> ITEM_OF), r) AS item_order,
  string_agg(printf('%.10f', score), '-' ORDER BY (item <> ITEM_OF), r) AS score_order
  FROM ({RANKED}) GROUP BY uid""".replace(
    "ITEM_OF", f"list_extract({ITEMS}, CAST(uid % 5 AS INT) + 1)"),
       ["fx_score"])
def promote_assigned(t):
    names = ranking.item_names(ITEMS)
    df = t.fx_score.select(
        "uid", names.alias("n"), ranking.rank_items(SCORES).alias("r"),
        F.get(names, (F.col("uid") % 5).cast("int")).alias("assigned"))
    df = df.select(
        "uid", "assigned", F.transform("r", lambda x: F.get(F.col("n"), x["idx"])).alias("items"),
        F.transform("r", lambda x: F.format_string("%.10f", x["score"])).alias("scores"))
    out = ranking.promote_assigned(df, "items", "scores", "assigned")
    return out.select("uid", F.array_join("items", "-").alias("item_order"),
                      F.array_join("scores", "-").alias("score_order"))


@query(f"SELECT uid, CAST(r - 1 AS INT) AS true_rank FROM ({RANKED}) WHERE idx = uid % 5",
       ["fx_score"])
def true_item_rank(t):
    return t.fx_score.select("uid", ranking.true_item_rank(
        SCORES, (F.col("uid") % 5).cast("int")).alias("true_rank"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rn, round(cum_w, 4) AS cum_w
  FROM (SELECT *, row_number() OVER o AS rn, sum(w) OVER (o ROWS UNBOUNDED PRECEDING) AS cum_w
  FROM fx_label WINDOW o AS (ORDER BY score DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey))""",
       ["fx_label"])
def cumulative_by_score(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    df = running(t.fx_label.select(*keys, "score", "w"), ["-score", *keys], sums=["w"])
    return df.select(*keys, "rn", F.round("cum_w", 4).alias("cum_w"))


@query("""WITH n AS (SELECT count(*) FILTER (item = 'view') AS ref,
    count(*) FILTER (item = 'purchase') AS tail FROM fx_positive)
  SELECT event_id, item, CAST(c AS INT) AS copy_no FROM (SELECT event_id, item,
    unnest(generate_series(1, CASE WHEN item = 'purchase' THEN ref // tail ELSE 1 END)) AS c
    FROM fx_positive, n)""", ["fx_positive"])
def oversample_to(t):
    df = t.fx_positive.select("event_id", "item")
    return ranking.oversample_to(df, "item", "view", ["purchase"])


@query("""SELECT p_brand AS feature, round(sum(l_extendedprice), 2) AS importance FROM lineitem
  JOIN part ON p_partkey = l_partkey GROUP BY p_brand ORDER BY 2 DESC, 1 LIMIT 10""")
def top_features(t):
    imp = (t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
           .groupBy(F.col("p_brand").alias("feature"))
           .agg(F.round(F.sum("l_extendedprice"), 2).alias("importance")))
    return ranking.top_features(imp, 10)


@query("""SELECT CAST(p * 10 AS INT) AS percent, round(list_extract(q, p + 1), 6) AS importance
  FROM (SELECT quantile_cont(p_retailprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9,
    1.0]) AS q, unnest(range(11)) AS p FROM part)""")
def importance_deciles(t):
    imp = t.part.select(F.col("p_retailprice").alias("importance"))
    return ranking.importance_deciles(imp).withColumn("importance", F.round("importance", 6))
