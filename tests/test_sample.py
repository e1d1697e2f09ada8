import collections

import pytest
from pyspark.sql import functions as F

from offerflow.operators import encode, sample, split

WEIGHTS = {"a": 1, "b": 2, "c": 5, "d": 1}


def positives(spark):
    rows = [(u, "w1", i) for u in range(40) for i in "abcd" if (u * 7 + ord(i)) % 3 == 0]
    rows += [(99, "w1", i) for i in "abcd"] + [(0, "w1", "a")] * 3
    return spark.createDataFrame(rows, "uid long, obs string, item string")


@pytest.mark.parametrize("replacement", [False, True])
@pytest.mark.parametrize("ratio", [1, 4])
def test_negatives(spark, replacement, ratio):
    pos = positives(spark)
    rows = sample.negative_sample(pos, WEIGHTS, ["uid", "obs"], "item", ratio, replacement, 1).collect()
    held = collections.defaultdict(set)
    for r in pos.collect():
        held[r["uid"]].add(r["item"])
    drawn = collections.defaultdict(list)
    for r in rows:
        if r["label"] == 0:
            drawn[r["uid"]].append(r["item"])
    assert sum(r["label"] for r in rows) == sum(len(h) for h in held.values())
    for uid, h in held.items():
        want = 0 if len(h) == len(WEIGHTS) else len(h) * ratio
        assert len(drawn[uid]) == want
        assert not set(drawn[uid]) & h
        if not replacement and want:
            pool = {i: w for i, w in WEIGHTS.items() if i not in h}
            copies = want // sum(pool.values()) + 1
            assert all(n <= pool[i] * copies for i, n in collections.Counter(drawn[uid]).items())


def test_same_draws_whatever_the_partitions(spark):
    pos = positives(spark)
    runs = [sorted(map(tuple, sample.negative_sample(
        pos.repartition(n), WEIGHTS, ["uid", "obs"], "item", 2, False, 5).collect())) for n in (1, 16)]
    assert runs[0] == runs[1]


def test_heavier_items_are_drawn_more(spark):
    pos = spark.range(2000).select(F.col("id").alias("uid"), F.lit("w").alias("obs"), F.lit("d").alias("item"))
    rows = sample.negative_sample(pos, WEIGHTS, ["uid", "obs"], "item", 1, True, 3).where("label = 0")
    n = {r["item"]: r["count"] for r in rows.groupBy("item").count().collect()}
    assert n["c"] / 2000 == pytest.approx(5 / 8, abs=0.05) and n["a"] / 2000 == pytest.approx(1 / 8, abs=0.05)


def test_one_key_with_many_of_many_items(spark):
    weights = {f"i{k:03d}": 1 + k % 5 for k in range(300)}
    rows = [(1, "w", f"i{3 * k:03d}") for k in range(100)]
    pos = spark.createDataFrame(rows, "uid long, obs string, item string")
    got = sample.negative_sample(pos, weights, ["uid", "obs"], "item", 3, False, 9).where("label = 0").collect()
    drawn = collections.Counter(r["item"] for r in got)
    assert sum(drawn.values()) == 300 and not set(drawn) & {r[2] for r in rows}
    assert all(n <= weights[i] for i, n in drawn.items())


def test_item_weights_round_half_to_even(spark):
    df = spark.createDataFrame([("a",)] * 2 + [("b",)] * 5 + [("c",)] * 7, "item string")
    got = {r["item"]: r["weight"] for r in sample.item_weights(df, "item").collect()}
    assert got == {"a": 1, "b": 2, "c": 4}


def test_folds_are_disjoint_and_even(spark):
    df = spark.range(1000).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    rows = split.stratified_kfold(df, ["id"], "y", 5, 7).collect()
    assert len({r["id"] for r in rows}) == 1000
    assert set(collections.Counter((r["fold"], r["y"]) for r in rows).values()) == {50, 150}


def test_stratified_split_is_exact(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    n = collections.Counter((r["y"], r["is_train"]) for r in split.stratified_split(df, ["id"], "y", 0.8, 7).collect())
    assert n == {(0, 1): 720, (0, 0): 180, (1, 1): 80, (1, 0): 20}


def test_unseen_category(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "x string")
    enc = encode.LabelEncoder.fit(train, ["x"])
    df = spark.createDataFrame([("b",), ("z",), (None,)], "x string")
    assert [r["x"] for r in enc.transform(df, -1).collect()] == [1, -1, -1]
    assert [r["x"] for r in enc.transform(df, 0).collect()] == [1, 0, 0]


def test_numbers_are_coded_in_number_order_and_large_columns_join(spark):
    df = spark.range(300).select("id", (F.col("id") * 10 % 3000).alias("x"))
    enc = encode.LabelEncoder.fit(df, ["x"])
    assert set(enc.codes) == {"x"}
    assert all(r["x"] == r["id"] for r in enc.transform(df).collect())


def test_scaler_with_zero_spread(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = encode.StandardScaler.fit(df, ["a", "b"]).transform(df).collect()
    assert [tuple(r) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]
