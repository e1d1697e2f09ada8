import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from offerflow.operators import joins, scoring, selection
from offerflow.sources import files, partitions


LOAD_SUM = lambda: (lambda x: x.sum(axis=1))


@pytest.fixture()
def users(spark):
    return spark.range(1000).select(F.col("id").alias("uid"), (F.col("id") % 7).cast("double").alias("a"),
                                    (F.col("id") / 10).alias("b"))


def test_batch_size_does_not_matter(spark, users):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, runs = spark.conf.get(key), []
    for size in ("7", "10000"):
        spark.conf.set(key, size)
        runs.append(sorted(map(tuple, scoring.score_batches(users, LOAD_SUM, ["a", "b"], ["uid"]).collect())))
    spark.conf.set(key, before)
    assert runs[0] == runs[1] and runs[0][13][1] == pytest.approx(6.0 + 1.3)


def test_items_get_their_condition(spark, users):
    out = scoring.score_items(users, LOAD_SUM, ["a"], ["uid"], {"x": [10.0, 0.5], "y": [0.0, 1.0]})
    assert out.columns == ["uid", "score_x", "score_y"]
    assert all(r["score_x"] == pytest.approx(r["uid"] % 7 + 10.5) and r["score_y"] == r["uid"] % 7 + 1
               for r in out.collect())


def test_embeddings_with_a_missing_vector(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "uid long, e array<float>")
    items = spark.createDataFrame([(5, [1.0, 0.0]), (6, [-2.0, 0.0])], "item long, e array<float>")
    got = {r["uid"]: r for r in scoring.score_embeddings(users, items, "uid", "item", "e", [5, 6]).collect()}
    assert got[1]["score_5"] == pytest.approx(1 / (1 + np.exp(-1))) and got[1]["score_6"] == pytest.approx(
        1 / (1 + np.exp(1)))
    assert got[2]["score_5"] is None and got[3]["score_5"] == 0.5
    with pytest.raises(ValueError):
        scoring.score_embeddings(users, items, "uid", "item", "e", [5, 7])


def test_embedding_pairs_in_blocks(spark):
    """Every pair once, whatever the blocks, with the scores of plain numpy."""
    rng = np.random.default_rng(1)
    u, v = rng.normal(size=(90, 5)), rng.normal(size=(40, 5))
    users = spark.createDataFrame([(i, [float(x) for x in r] if i % 10 else None) for i, r in enumerate(u)], "uid long, e array<float>")
    items = spark.createDataFrame([(f"i{j}", [float(x) for x in r] if j != 3 else None) for j, r in enumerate(v)], "item string, e array<double>")
    cosine = (u @ v.T) / (np.linalg.norm(u, axis=1)[:, None] * np.linalg.norm(v, axis=1) + 1e-8)
    for blocks in ((7, 11), (1000, 1000)):
        got = {(r["uid"], r["item"]): r["score"] for r in scoring.score_embedding_pairs(
            users, items, "uid", "item", "e", *blocks).collect()}
        assert len(got) == 90 * 40
        for (i, j), score in got.items():
            if i % 10 and j != "i3":
                assert score == pytest.approx(1 / (1 + np.exp(-cosine[i, int(j[1:])])), abs=1e-6)
            else:
                assert score is None
    plan = scoring.score_embedding_pairs(users, items, "uid", "item", "e")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert scoring.score_embedding_pairs(users, items.limit(0), "uid", "item", "e").collect() == []


@pytest.mark.parametrize("chunk", [50, 4])
def test_expand_items_in_blocks_gives_every_pair_once(spark, users, chunk):
    items = spark.range(11).select(F.col("id").alias("item"), F.lit("x").alias("c"))
    out = joins.expand_items(users.limit(90), items, chunk)
    assert out.count() == 990 == out.select("uid", "item").distinct().count()


def test_expand_items_in_blocks_broadcasts_nothing_and_spreads_the_pairs(spark, users):
    items = spark.range(40).select((F.col("id") % 20).alias("item"))
    out = joins.expand_items(users.limit(90).select("uid"), items, 4)
    spread = out.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert sum(r["count"] for r in spread) == 90 * 40 and len(spread) > 1
    assert {r["count"] for r in out.groupBy("uid", "item").count().collect()} == {2}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_expand_items_in_blocks_writes_little_for_a_pair(spark, tmp_path):
    """Items in runs, users in short cycles: a pair takes a fraction of a byte, not an item's code or value."""
    users, items = spark.range(1200).select(F.col("id").alias("uid")), spark.range(12000).select((F.col("id") * 7919).alias("item"))
    joins.expand_items(users, items, 16).write.parquet(str(tmp_path / "t"))
    out = spark.read.parquet(str(tmp_path / "t"))
    got = out.agg(F.count(F.lit(1)), F.sum(F.xxhash64("uid", "item").cast("decimal(38,0)"))).first()
    want = users.crossJoin(items).agg(F.count(F.lit(1)), F.sum(F.xxhash64("uid", "item").cast("decimal(38,0)"))).first()
    assert tuple(got) == tuple(want) and got[0] == 1200 * 12000
    assert sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet")) < 0.8 * got[0]


def test_expand_items_in_blocks_spreads_equal_users(spark):
    """Equal rows stay apart: each is paired with the whole list, and they do not share one task."""
    users = spark.createDataFrame([(None, "a")] * 90 + [(5, None)], "uid long, c string")
    items = spark.createDataFrame([(i if i else None,) for i in range(10)] * 2, "item long")
    out = joins.expand_items(users, items, 4)
    assert out.columns == ["uid", "c", "item"]
    got = {tuple(r)[:3]: r["count"] for r in out.groupBy("uid", "c", "item").count().collect()}
    assert got == {(u, c, i or None): n * 2 for u, c, n in ((None, "a", 90), (5, None, 1)) for i in range(10)}
    assert out.where("uid is null").select(F.spark_partition_id()).distinct().count() > 1


def test_partition_overwrite_is_idempotent(spark, users, tmp_path):
    path = str(tmp_path / "t")
    partitions.write_partition(users, path, "2024-02-03", exp_mode="a")
    partitions.write_partition(users.limit(10), path, "2024-02-04", exp_mode="a")
    for _ in range(2):
        partitions.write_partition(users.limit(5), path, "2024-02-03", exp_mode="a")
    assert partitions.read_partition(spark, path, "2024-02-03", exp_mode="a").count() == 5
    assert partitions.read_partition(spark, path, "2024-02-04", exp_mode="a").count() == 10
    partitions.carry_forward(spark, path, "2024-02-04", "2024-02-05", exp_mode="a")
    assert partitions.read_partition(spark, path, "2024-02-05", exp_mode="a").count() == 10


def test_partition_columns_are_pruned(spark, users, tmp_path):
    path = str(tmp_path / "t")
    partitions.write_partition(users, path, "2024-02-03")
    df = partitions.read_partition(spark, path, "2024-02-03", ["uid"])
    assert df.inputFiles() and all("/year=2024/month=02/day=03/" in f for f in df.inputFiles())
    assert "ReadSchema: struct<uid:bigint>" in df._jdf.queryExecution().executedPlan().toString()


def test_broken_sibling_is_not_touched(spark, users, tmp_path):
    path = str(tmp_path / "t")
    partitions.write_partition(users, path, "2024-02-03", exp_mode="a")
    partitions.write_partition(users, path, "2024-02-04", exp_mode="a")
    for broken in (tmp_path / "t/year=2024/month=02/day=04").rglob("*.parquet"):
        broken.write_bytes(b"no parquet")
    other = tmp_path / "t/year=2024/month=02/day=05/role=x"
    other.mkdir(parents=True)
    (other / "part-0.parquet").write_bytes(b"other levels")
    for parts in ({"exp_mode": "a"}, {}):
        assert partitions.read_partition(spark, path, "2024-02-03", ["uid"], **parts).count() == users.count()
    with pytest.raises(ValueError):
        partitions.carry_forward(spark, path, "2024-02-03", "2024-03-01", role="x")


def test_tsv(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä b"), (2, "c,d")], "k int, v string")
    files.export_tsv(df, str(tmp_path / "x"), header=True, single_file=True)
    assert sorted(map(tuple, files.read_tsv(spark, str(tmp_path / "x"), df.schema).collect())) == [(1, "ä b"), (2, "c,d")]


def test_unite_samples_checks_names(spark):
    a = spark.createDataFrame([(1, 2)], "k int, v int")
    b = spark.createDataFrame([(3, 4)], "v int, k int")
    assert sorted(map(tuple, files.unite_samples([a, b], ["k", "v"]).collect())) == [(1, 2), (4, 3)]
    with pytest.raises(ValueError):
        files.select_features(a, ["k"], ["nope"])


def test_shuffle_is_a_permutation(spark, users):
    out = selection.shuffle_columns(users, ["uid"], ["b"], 1).collect()
    assert sorted(r["b"] for r in out) == sorted(r["b_shuffled"] for r in out)
    assert sum(r["b"] == r["b_shuffled"] for r in out) < 20


def test_unused_feature_has_no_permutation_importance(spark, users):
    df = users.withColumn("y", (F.col("b") > 50).cast("int"))
    out = selection.permutation_importance(df, ["uid"], ["a", "b"], "y", lambda x: x.withColumn("score", F.col("b")))
    got = {r["feature"]: r["importance"] for r in out.collect()}
    assert got["a"] == pytest.approx(0.0) and got["b"] > 0.3


def test_trees_on_weighted_cells_are_the_trees_of_all_rows(spark):
    rows = spark.range(6000).select(
        (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"),
        F.when(F.col("id") % 13 > 0, (F.xxhash64("id") % 5).cast("double")).alias("c"))
    rows = rows.withColumn("y", (F.col("a") * 2 + F.col("b") + F.coalesce("c", F.lit(0.0)) > 11).cast("int"))
    params = {"maxIter": 3, "maxDepth": 3, "seed": 1}
    plain = rows.fillna(0.0)
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(plain)
    whole = GBTClassifier(labelCol="y", **params).fit(data)
    model = selection.boosted_trees(rows, ["a", "b", "c"], "y", **params)
    assert np.allclose(model.stages[-1].featureImportances.toArray(), whole.featureImportances.toArray(), atol=1e-9)
    got, want = (m.transform(d).groupBy("a", "b", "c").agg(F.max("probability").alias("p")).collect()
                 for m, d in ((model, plain), (whole, data)))
    want = {(r.a, r.b, r.c): r.p[1] for r in want}
    assert all(abs(want[r.a, r.b, r.c] - r.p[1]) < 1e-9 for r in got)


def test_trees_keep_cells_not_rows(spark):
    rows = spark.range(40_000).select((F.col("id") % 3).cast("double").alias("a"), (F.rand(1) * 1e6).alias("b"),
                                      (F.col("id") % 2).alias("y"))
    seen = []
    keep = selection.GBTClassifier.fit
    selection.GBTClassifier.fit = lambda self, df: seen.append(df.count()) or keep(self, df)
    try:
        model = selection.boosted_trees(rows, ["a", "b"], "y", maxIter=1, maxDepth=2, seed=1)
    finally:
        selection.GBTClassifier.fit = keep
    assert seen[0] <= 3 * 32 * 2
    sizes = [r["n"] for r in model.stages[0].transform(rows).groupBy("_bin_b").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 32 and max(sizes) < 1.1 * 40_000 / 32


def test_null_importance_deals_all_labels_without_moving_rows(spark, monkeypatch):
    rows = spark.range(3000).select("id", (F.col("id") % 6).cast("double").alias("a"), (F.col("id") % 10 < 3).cast("int").alias("y"))
    seen, fit = [], selection._fit
    monkeypatch.setattr(selection, "shuffle_columns", None)
    monkeypatch.setattr(selection, "_fit", lambda cells, *rest, **params: seen.append(cells.collect()) or fit(cells, *rest, **params))
    got = selection.null_importance(rows, ["id"], ["a"], "y", k=3, maxIter=1, maxDepth=2, seed=1).collect()
    assert [r["feature"] for r in got] == ["a"] and len(seen) == 4
    dealt = [{(r["_bin_a"], r["y"]): r["_weight"] for r in cells} for cells in seen]
    for cells in dealt:  # every label is dealt once, every row gets one
        assert [sum(n for (_, y), n in cells.items() if y == label) for label in (0, 1)] == [2100, 900]
        assert all(cells[b, 0] + cells[b, 1] == 500 for b in range(6))
    assert dealt[0][0, 1] == rows.where("a = 0 AND y = 1").count()
    assert len({tuple(sorted(c.items())) for c in dealt}) == 4
    assert all(abs(cells[b, 1] - 150) < 60 for cells in dealt[1:] for b in range(6))
