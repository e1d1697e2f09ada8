"""Encoding, splitting and sampling."""

from pyspark.sql import functions as F

from offerflow.operators import encode, sample, split
from offerflow.plans.catalog import query
from offerflow.plans.rows import hash_sql

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_TEXT = " || '|' || ".join(KEYS)
K = ", ".join(KEYS)


@query("""WITH seg AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code FROM
    (SELECT DISTINCT c_mktsegment AS v FROM customer WHERE c_acctbal > 5000)),
  nat AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code FROM
    (SELECT DISTINCT c_nationkey AS v FROM customer WHERE c_acctbal > 9000)),
  nam AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code FROM
    (SELECT DISTINCT c_name AS v FROM customer WHERE c_acctbal > 5000))
  SELECT c_custkey AS uid, coalesce(seg.code, -1) AS segment, coalesce(nam.code, -1) AS name
  FROM customer LEFT JOIN seg ON seg.v = c_mktsegment LEFT JOIN nam ON nam.v = c_name""")
def label_encode(t):
    df = t.customer.select(F.col("c_custkey").alias("uid"), F.col("c_mktsegment").alias("segment"),
                           F.col("c_name").alias("name"), "c_acctbal")
    enc = encode.LabelEncoder.fit(df.where("c_acctbal > 5000"), ["segment", "name"])
    return enc.transform(df, unseen=-1).select("uid", "segment", "name")


@query("""WITH d AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code FROM
    (SELECT DISTINCT o_orderdate AS v FROM orders)),
  k AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code FROM
    (SELECT DISTINCT o_custkey + 9007199254740992 AS v FROM orders))
  SELECT o_orderkey, d.code AS day, k.code AS big FROM orders JOIN d ON d.v = o_orderdate
  JOIN k ON k.v = o_custkey + 9007199254740992""")
def label_encode_dates(t):
    df = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"),
                         (F.col("o_custkey") + F.lit(2 ** 53)).alias("big"))
    return encode.LabelEncoder.fit(df, ["day", "big"]).transform(df)


SCALE = """WITH s AS (SELECT avg(x1) m1, stddev_pop(x1) s1, avg(x2) m2, stddev_pop(x2) s2,
    min(x1) lo1, max(x1) hi1, min(x2) lo2, max(x2) hi2 FROM fx_label WHERE item = 'F') """


@query(SCALE + f"SELECT {K}, round((x1 - m1) / s1, 6) AS x1, round((x2 - m2) / s2, 6) AS x2"
       " FROM fx_label, s", ["fx_label"])
def standard_scale(t):
    scaler = encode.StandardScaler.fit(t.fx_label.where("item = 'F'"), ["x1", "x2"])
    return scaler.transform(t.fx_label.select(*KEYS, "x1", "x2")).withColumns(
        {"x1": F.round("x1", 6), "x2": F.round("x2", 6)})


@query(SCALE + f"SELECT {K}, (x1 - lo1) / (hi1 - lo1) AS x1, (x2 - lo2) / (hi2 - lo2) AS x2"
       " FROM fx_label, s", ["fx_label"])
def minmax_scale(t):
    scaler = encode.MinMaxScaler.fit(t.fx_label.where("item = 'F'"), ["x1", "x2"])
    return scaler.transform(t.fx_label.select(*KEYS, "x1", "x2"))


@query("SELECT event_id, item, " + ", ".join(
    f"CAST(item = '{i}' AS INT) AS item_{i}"
    for i in ["click", "error", "purchase", "signup", "view"]) + " FROM fx_positive",
       ["fx_positive"])
def one_hot(t):
    return encode.one_hot(t.fx_positive.select("event_id", "item"), "item")


@query("""SELECT feature, CASE WHEN n <= 25 THEN 'sparse' ELSE 'dense' END AS kind FROM (
  SELECT 'x1' AS feature, count(DISTINCT x1) AS n FROM fx_label UNION ALL
  SELECT 'x3', count(DISTINCT x3) FROM fx_label UNION ALL
  SELECT 'x4', count(DISTINCT x4) FROM fx_label UNION ALL
  SELECT 'item', count(DISTINCT item) FROM fx_label)""", ["fx_label"])
def split_low_card(t):
    cols = ["x1", "x3", "x4", "item"]
    sparse, _ = encode.split_low_card(t.fx_label, cols)
    return t.spark.createDataFrame([(c, "sparse" if c in sparse else "dense") for c in cols],
                                   "feature string, kind string")


@query("""WITH s AS (SELECT avg(c_acctbal) m, stddev_pop(c_acctbal) sd FROM customer),
  seg AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code FROM
    (SELECT DISTINCT c_mktsegment AS v FROM customer)),
  nat AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code FROM
    (SELECT DISTINCT c_nationkey AS v FROM customer))
  SELECT c_custkey, seg.code AS c_mktsegment, nat.code AS c_nationkey,
    round((c_acctbal - m) / sd, 6) AS c_acctbal FROM customer
  JOIN seg ON seg.v = c_mktsegment JOIN nat ON nat.v = c_nationkey, s""")
def transform_features(t):
    df = t.customer
    enc = encode.LabelEncoder.fit(df, ["c_mktsegment", "c_nationkey"])
    scaler = encode.StandardScaler.fit(df, ["c_acctbal"])
    return encode.transform_features(df, ["c_custkey"], enc, scaler).withColumn(
        "c_acctbal", F.round("c_acctbal", 6))


@query(f"""SELECT event_id, CAST({hash_sql("uid || '|' || obs_dt || '|11'")} < 3435973836 AS INT)
  AS is_train FROM fx_positive""", ["fx_positive"])
def split_by_entity(t):
    out = split.split_by_entity(t.fx_positive, ["uid", "obs_dt"], 0.8, 11)
    return out.select("event_id", "is_train")


@query(f"""SELECT {K}, CAST({hash_sql(KEY_TEXT + " || '|5'")} < 3865470566 AS INT) AS is_train
  FROM fx_label""", ["fx_label"])
def random_split(t):
    return split.random_split(t.fx_label.select(*KEYS), KEYS, 0.9, 5)


@query(f"""SELECT {K}, label, CAST(row_number() OVER (PARTITION BY label ORDER BY
    {hash_sql(KEY_TEXT + " || '|5'")}, {K}) <= round(count(*) OVER (PARTITION BY label) * 0.8::DOUBLE)
    AS INT) AS is_train FROM fx_label""", ["fx_label"])
def stratified_split(t):
    return split.stratified_split(t.fx_label.select(*KEYS, "label"), KEYS, "label", 0.8, 5)


@query(f"""SELECT {K}, label, CAST((row_number() OVER (PARTITION BY label ORDER BY
    {hash_sql(KEY_TEXT + " || '|2021'")}, {K}) - 1) % 5 AS INT) AS fold FROM fx_label""",
       ["fx_label"])
def stratified_kfold(t):
    return split.stratified_kfold(t.fx_label.select(*KEYS, "label"), KEYS, "label", 5, 2021)


WEIGHTS = """w AS (SELECT item, count(*) AS n, CAST(round_even(count(*) / (SELECT min(n) FROM
    (SELECT count(*) AS n FROM fx_positive GROUP BY item)), 0) AS BIGINT) AS weight
    FROM fx_positive GROUP BY item)"""


@query(f"WITH {WEIGHTS} SELECT item, n, weight FROM w", ["fx_positive"])
def item_weights(t):
    return sample.item_weights(t.fx_positive, "item")


def negatives_sql(ratio: int, seed: int, replacement: bool) -> str:
    copies = "1" if replacement else f"(len(held) * {ratio} // greatest(size0, 1) + 1)"
    taken = "0" if replacement else "1"
    cum = "list_transform(range(1, len(pool) + 1), lambda i: list_sum(pool[1:i]))"
    pos = hash_sql("uid || '|' || obs_dt || '|' || (j + 1) || '|{}'".format(seed))
    return f"""WITH RECURSIVE {WEIGHTS},
  held AS (SELECT uid, obs_dt, list(DISTINCT item) AS held FROM fx_positive GROUP BY ALL),
  pool0 AS (SELECT uid, obs_dt, held, (SELECT list(item ORDER BY item) FROM w) AS names,
    list_transform((SELECT list({{'item': item, 'weight': weight}} ORDER BY item) FROM w),
      lambda x: CASE WHEN list_contains(held, x.item) THEN 0 ELSE x.weight END) AS pool FROM held),
  pool1 AS (SELECT *, list_sum(pool)::BIGINT AS size0 FROM pool0),
  draws AS (
    SELECT uid, obs_dt, names, 0::BIGINT AS j, CASE WHEN size0 > 0 THEN len(held) * {ratio} ELSE 0 END AS k,
      list_transform(pool, lambda x: (x * {copies})::BIGINT) AS pool, (size0 * {copies})::BIGINT AS size,
      NULL::BIGINT AS hit FROM pool1
    UNION ALL
    SELECT uid, obs_dt, names, j + 1, k, list_transform(pool, lambda x, i: CASE WHEN i = h THEN x - {taken}
      ELSE x END), size - {taken}, h FROM (
      SELECT *, len(list_filter({cum}, lambda c: c <= {pos} % size)) + 1 AS h
      FROM draws WHERE j < k))
  SELECT uid, obs_dt, names[hit] AS item, 0 AS label FROM draws WHERE j > 0
  UNION ALL SELECT DISTINCT uid, obs_dt, item, 1 FROM fx_positive"""


def _negatives(t, ratio, seed, replacement):
    return sample.negative_sample(t.fx_positive, sample.item_weights(t.fx_positive, "item"),
                                  ["uid", "obs_dt"], "item", ratio, replacement, seed)


@query(negatives_sql(2, 42, False), ["fx_positive"])
def negative_sample(t):
    return _negatives(t, 2, 42, False)


@query(negatives_sql(3, 43, True), ["fx_positive"])
def negative_sample_replacement(t):
    return _negatives(t, 3, 43, True)


@query(f"""WITH pos AS (SELECT DISTINCT o_custkey AS uid, l_partkey AS item FROM orders JOIN lineitem
    ON l_orderkey = o_orderkey),
  n AS (SELECT l_partkey AS item, count(*) AS n FROM lineitem GROUP BY l_partkey),
  w AS (SELECT item, CAST(round_even(n / (SELECT min(n) FROM n), 0) AS BIGINT) AS weight FROM n),
  held AS (SELECT uid, count(*) AS k FROM pos GROUP BY uid),
  pool AS (SELECT h.uid, w.item, weight, (sum(weight) OVER (PARTITION BY h.uid ORDER BY w.item) - weight)::BIGINT AS start
    FROM held h, w WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.uid = h.uid AND p.item = w.item)),
  size AS (SELECT uid, sum(weight)::BIGINT AS size FROM pool GROUP BY uid),
  draws AS (SELECT uid, {hash_sql("uid || '|' || j || '|44'")} % size AS at FROM
    (SELECT uid, unnest(range(1, k + 1)) AS j FROM held) JOIN size USING (uid))
  SELECT d.uid, p.item, 0 AS label FROM draws d ASOF JOIN pool p ON d.uid = p.uid AND d.at >= p.start
  UNION ALL SELECT uid, item, 1 FROM pos""")
def negative_sample_parts(t):
    """A catalogue of all parts."""
    bought = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("uid"), F.col("l_partkey").alias("item"))
    weights = sample.item_weights(t.lineitem.select(F.col("l_partkey").alias("item")), "item")
    return sample.negative_sample(bought, weights, ["uid"], "item", 1, True, 44)
