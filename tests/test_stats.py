import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from offerflow.operators import evaluate, profile, stats
from tails import f_tail


def frame(spark, n=150, seed=2):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, n).astype(float), "b": rng.integers(0, 5, n).astype(float),
                        "w": rng.integers(1, 5, n).astype(float)})
    pdf["b"] += (pdf.a > 4)
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("weight", [None, "w"])
def test_kendall_equals_all_pairs(spark, weight):
    pdf, df = frame(spark)
    w = pdf[weight] if weight else pd.Series(1.0, index=pdf.index)
    p = q = t = u = 0.0
    for i, j in itertools.combinations(pdf.index, 2):
        dx, dy = pdf.a[i] - pdf.a[j], pdf.b[i] - pdf.b[j]
        m = w[i] * w[j]
        p += m * (dx * dy > 0)
        q += m * (dx * dy < 0)
        t += m * (dx == 0 and dy != 0)
        u += m * (dx != 0 and dy == 0)
    got = stats.kendall(df, [("a", "b")], weight).first()["corr"]
    assert got == pytest.approx((p - q) / np.sqrt((p + q + t) * (p + q + u)))


def test_spearman_with_and_without_holes(spark):
    pdf, df = frame(spark)
    want = pdf[["a", "b"]].corr(method="spearman").iloc[0, 1]
    assert stats.corr_matrix(df, ["a", "b"], "spearman").first()["corr"] == pytest.approx(want)
    holes = df.withColumn("b", F.when(F.col("a") != 3, F.col("b")))
    masked = pdf.assign(b=pdf.b.where(pdf.a != 3))
    want = masked[["a", "b"]].corr(method="spearman").iloc[0, 1]
    assert stats.corr_matrix(holes, ["a", "b"], "spearman").first()["corr"] == pytest.approx(want)


def test_constant_column_has_correlation_zero(spark):
    _, df = frame(spark)
    for method in ("pearson", "spearman", "kendall"):
        got = stats.corr_matrix(df.withColumn("c", F.lit(1.0)), ["a", "c"], method).first()["corr"]
        assert got == 0.0


def ols_f(y, x_full, x_small):
    def rss(x):
        beta, *_ = np.linalg.lstsq(x, y, rcond=None)
        return float(((y - x @ beta) ** 2).sum())
    d2 = len(y) - np.linalg.matrix_rank(x_full)
    return (rss(x_small) - rss(x_full)) / (rss(x_full) / d2), d2


def test_conditional_f_equals_regression_with_dummies(spark):
    pdf, df = frame(spark)
    pdf["y"] = (pdf.a + pdf.w > 6).astype(float)
    items = pd.get_dummies(pdf.b).to_numpy(float)
    score, d2 = ols_f(pdf.y.to_numpy(), np.column_stack([items, pdf.a]), items)
    got = stats.conditional_f(spark.createDataFrame(pdf), ["a"], "y", "b").first()
    assert got["score"] == pytest.approx(score)
    assert got["p_value"] == pytest.approx(f_tail(score, 1, d2))


def test_uplift_f_equals_interaction_test(spark):
    pdf, _ = frame(spark, 300)
    rng = np.random.default_rng(0)
    pdf["arm"] = rng.choice(["control", "t1", "t2"], len(pdf))
    pdf["y"] = (pdf.a * (pdf.arm == "t1") + rng.normal(0, 4, len(pdf)) > 4).astype(float)
    got = {r["arm"]: r for r in stats.uplift_scores(spark.createDataFrame(pdf), ["a"], "arm", "control", "y").collect()}
    mean = 0.0
    for arm in ("t1", "t2"):
        part = pdf[pdf.arm.isin(["control", arm])]
        t = (part.arm == arm).to_numpy(float)
        full = np.column_stack([np.ones(len(part)), t, part.a, t * part.a])
        score, d2 = ols_f(part.y.to_numpy(), full, full[:, :3])
        assert got[arm]["score"] == pytest.approx(score) and got[arm]["d2"] == d2
        mean += f_tail(score, 1, d2) * t.sum()
    row = stats.uplift_f(spark.createDataFrame(pdf), ["a"], "arm", "control", "y").first()
    assert row["p_value_mean"] == pytest.approx(mean / (pdf.arm != "control").sum())
    assert row["keep"] == int(row["p_value_mean"] <= 0.05)


def test_anova_flags(spark):
    pdf, df = frame(spark)
    rows = stats.anova_f(df.withColumn("y", (F.col("a") > 4).cast("int")), ["a", "b", "w"], "y", k=2).collect()
    assert [r["feature"] for r in rows][0] == "a" and sum(r["is_selected_score"] for r in rows) == 2
    assert all(r["is_selected_p"] == int(r["p_value"] <= 0.05) for r in rows)


def test_drop_constant(spark):
    _, df = frame(spark)
    assert "c" not in profile.drop_constant(df.withColumn("c", F.lit(2)), ["a", "c"]).columns


def test_threshold_table_counts_every_cut(spark):
    rng = np.random.default_rng(4)
    score = np.round(rng.random(500), 2)  # many scores exactly on a threshold
    y = (rng.random(500) < score).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"s": score, "y": y}))
    for r in evaluate.threshold_table(df, "y", "s", evaluate.thresholds()).collect():
        picked = score >= r["threshold"]
        assert r["count"] == picked.sum()
        assert r["recall"] == pytest.approx(y[picked].sum() / y.sum())


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("b", 1, 0.1)], "g string, y int, s double")
    got = {r["g"]: r["auc"] for r in evaluate.auc(df, "y", "s", ["g"]).collect()}
    assert got == {"a": 0.75, "b": None}


def test_ips_loss_by_hand(spark):
    rows = [(0.9, 0.5, 1, 1), (0.4, 0.7, 0, 0), (0.6, 0.2, 1, 0)]
    df = spark.createDataFrame(rows, "p1 double, p2 double, y1 int, y2 int")
    got = evaluate.ips_loss(df, ["y1", "y2"], ["p1", "p2"]).first()["ips_loss"]
    bce = lambda p, y: -(y * np.log(p) + (1 - y) * np.log(1 - p))
    p1, p2, y1, y2 = (np.array(c, float) for c in zip(*rows))
    want = bce(p1, y1).mean() + bce(p1 * p2, y2).mean() + 0.1 * (bce(p2, y2) * y1 / p1).mean()
    assert got == pytest.approx(want)


@pytest.mark.parametrize("weight", [None, "w"])
def test_rank_correlations_of_all_pairs_with_nulls(spark, weight):
    """Every pair over the rows that hold both, against pandas; one column is constant, one nearly empty."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({c: rng.integers(0, 12, 400).astype(float) for c in "abcd"})
    pdf["b"] += pdf.a
    pdf.loc[rng.random(400) < 0.3, "b"] = np.nan
    pdf.loc[rng.random(400) < 0.5, "c"] = np.nan
    pdf["d"], pdf["e"] = 3.0, np.where(np.arange(400) == 7, 1.0, np.nan)
    pdf["w"] = rng.integers(1, 4, 400).astype(float)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double, e double, w double")
    got = {(r["x"], r["y"]): r["corr"] for r in stats.corr_matrix(df, list("abcde"), "spearman", weight).collect()}
    assert len(got) == 10
    for (x, y), corr in got.items():
        both = pdf[pdf[x].notna() & pdf[y].notna()]
        p, q = both[x].rank(), both[y].rank()
        if weight:
            n = both.w.sum()
            want = 1 - 6 * (both.w * (p - q) ** 2).sum() / (n * (n * n - 1)) if n > 1 else 0.0
        else:
            want = p.corr(q) if len(both) > 1 and p.std() and q.std() else 0.0
        assert corr == pytest.approx(want, abs=1e-9), (x, y)


def test_all_kendall_pairs_in_one_plan(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({c: rng.integers(0, 6, 120).astype(float) for c in "abc"})
    pdf.loc[rng.random(120) < 0.2, "c"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double")
    for r in stats.corr_matrix(df, ["a", "b", "c"], "kendall").collect():
        both = pdf[pdf[r["x"]].notna() & pdf[r["y"]].notna()]
        s = t = u = 0
        for (x1, y1), (x2, y2) in itertools.combinations(zip(both[r["x"]], both[r["y"]]), 2):
            s += np.sign((x1 - x2) * (y1 - y2))
            t += x1 != x2
            u += y1 != y2
        assert r["corr"] == pytest.approx(s / np.sqrt(float(t) * u))


def test_spearman_keeps_frequent_values_out_of_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(stats, "FREQUENT", 10)
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(700)).cast("double")).alias("a"),
        F.when(F.col("id") % 5 > 0, F.pmod(F.xxhash64("id"), F.lit(4)).cast("double")).otherwise(F.col("id").cast("double")).alias("b"))
    out = stats.spearman(df, [("a", "b")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan
    ranks = df.toPandas().rank()
    assert out.first()["corr"] == pytest.approx(ranks["a"].corr(ranks["b"]), abs=1e-9)
    values = [(0, 5.0), (0, 5.0), (0, 5.0), (0, 1.0), (1, 5.0)]
    long = spark.createDataFrame(values, "f int, v double")
    table = spark.createDataFrame([(0, 5.0, 3, 3.0), (0, 1.0, 1, 1.0), (1, 5.0, 1, 1.0)], "f int, v double, n long, avg_rank double")
    for many in (0, 1, 2, 9):
        got = sorted(tuple(r) for r in stats._ranked(long, table, many).select("f", "v", "avg_rank").collect())
        assert got == [(0, 1.0, 1.0), (0, 5.0, 3.0), (0, 5.0, 3.0), (0, 5.0, 3.0), (1, 5.0, 1.0)]
