"""Whole jobs on small tables: what the registered queries do not show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerflow.operators import jobs
from offerflow.session import scratch_folder
from offerflow.sources.partitions import read_partition, write_partition


def test_models_have_their_own_fill_values_and_names(spark):
    df = spark.createDataFrame([(1, 0.5, None), (2, float("nan"), 2.0)], "uid long, a double, b double")
    one = jobs.ScoringModel(["p"], {"a": 10.0}, lambda: lambda x: x[:, 0])
    two = jobs.ScoringModel(["q", "r"], {"b": -1.0, "a": 0.0}, lambda: lambda x: np.stack([x[:, 0], x.sum(axis=1)], axis=1),
                            {"r": lambda c: c * 2})
    got = {r["uid"]: (r["p"], r["q"], r["r"]) for r in jobs.score_models(df, [one, two], ["uid"]).collect()}
    assert got == {1: (0.5, -1.0, -1.0), 2: (10.0, 2.0, 4.0)}
    with pytest.raises(ValueError):
        jobs.score_models(df, [one, jobs.ScoringModel(["p"], {"b": 0.0}, lambda: lambda x: x[:, 0])], ["uid"])
    plan = jobs.score_models(df, [one, two], ["uid"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_uplift_job_replaces_its_day(spark):
    root = f"{scratch_folder(spark)}/uplift-test"
    for n in (4, 3):
        write_partition(spark.range(n).selectExpr("id AS uid", "CAST(id AS DOUBLE) AS x", "'z' AS other"), f"{root}/in", "2024-03-01")
        jobs.uplift_scoring_job(spark, f"{root}/in", f"{root}/out", "2024-03-01", "2024-03-02", "uid", {"x": 0.0}, ["a", "b"],
                                lambda: [(lambda x: x[:, 0], lambda x: 3 * x[:, 0]), (lambda x: 0 * x[:, 0], lambda x: 0 * x[:, 0] + 1)], [0.5, 0.25])
    out = read_partition(spark, f"{root}/out", "2024-03-02").orderBy("uid").collect()
    assert [(r["uid"], r["score_a"], r["score_b"]) for r in out] == [(0, 0.0, 0.25), (1, 2.0, 0.25), (2, 4.0, 0.25)]


def test_feature_selection_keeps_what_the_model_needs(spark):
    rng = np.random.default_rng(2)
    n = 3000
    x, z, noise = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = (x + 0.5 * z + 0.3 * rng.normal(size=n) > 0).astype(int)
    rows = [(i, float(x[i]), float(z[i]), float(noise[i]), 1.0, None, int(y[i]), f"i{i % 3}") for i in range(n)]
    df = spark.createDataFrame(rows, "uid long, x double, z double, noise double, flat double, lost double, y int, item string")

    def score(rows):
        return rows.withColumn("score", sum((F.col(c) * w for c, w in (("x", 1.0), ("z", 0.5)) if c in rows.columns), F.lit(0.0)))

    got = {r["feature"]: r for r in jobs.feature_selection(
        df, [["x", "noise", "flat"], ["z", "lost"]], ["uid"], "y", "item", score, p_threshold=1e-6).collect()}
    assert {f for f, r in got.items() if r["selected"]} == {"x", "z"} == {f for f, r in got.items() if r["tested"]}
    assert got["flat"]["constant"] and got["flat"]["score"] is None and got["lost"]["constant"]
    assert got["x"]["group"] == 0 and got["z"]["group"] == 1 and got["x"]["importance"] > got["z"]["importance"] > 0
    assert got["noise"]["importance"] is None
