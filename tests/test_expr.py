import hashlib
import math

import pytest
from pyspark.sql import functions as F

from offerflow.functions import expr as E
from offerflow.functions.pvalue import chi2_pvalue, f_pvalue, log_gamma
from offerflow.operators import ranking
from tails import chi2_tail, f_tail


def test_salted_bucket_equals_hashlib(spark):
    def want(uid, salt, n):
        inner = hashlib.sha1(f"{uid}{salt}".encode()).hexdigest()
        return int(hashlib.md5(inner.encode()).hexdigest(), 16) % n

    for n in (100, 7, 999_983):
        rows = spark.range(200).select("id", E.salted_bucket("id", "spring", n).alias("b")).collect()
        assert all(r["b"] == want(r["id"], "spring", n) for r in rows)


def test_tie_order_of_ranking(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5, 0.2), (2, 0.1, 0.9, 0.9)], "uid int, a double, b double, c double")
    got = {r["uid"]: [x["idx"] for x in r["r"]] for r in df.select(
        "uid", ranking.rank_items(["a", "b", "c"]).alias("r")).collect()}
    assert got == {1: [1, 0, 2], 2: [2, 1, 0]}
    ranks = df.select(*[ranking.true_item_rank(["a", "b", "c"], F.lit(i)).alias(f"r{i}") for i in range(3)])
    assert [tuple(r) for r in ranks.collect()] == [(1, 0, 2), (2, 1, 0)]


def test_rules(spark):
    df = spark.createDataFrame([(1, None, 1, 0), (2, None, None, None), (3, 0, 0, 0)],
                               "uid int, a int, b int, c int")
    got = {r["uid"]: r["m"] for r in df.select("uid", E.rule_none(["a", "b", "c"]).alias("m")).collect()}
    assert got == {1: 1, 2: None, 3: 0}
    w = spark.createDataFrame([(0.8, 0), (0.8, 1), (0.8, None)], "s double, r int").select(
        E.apply_rule_weight("s", "r").alias("w")).collect()
    assert w[0]["w"] == pytest.approx(0.8e-10) and w[1]["w"] == 0.8 and w[2]["w"] is None


def test_calibration(spark):
    df = spark.createDataFrame([(0.4,)], "s double")
    a = df.select(E.calibrate_neg_sampling("s", 0.1).alias("x"),
                  E.calibrate_chain("s", F.lit(1.0), 0.1).alias("y"),
                  E.calibrate_chain("s", F.lit(0.0), 0.1).alias("z")).first()
    assert a["x"] == pytest.approx(0.4 / (0.4 + 0.6 / 0.1))
    assert a["y"] == pytest.approx(a["x"]) and a["z"] == pytest.approx(0.4)


def test_promote_refuses_an_unlisted_item(spark):
    df = spark.createDataFrame([(["a", "b"], ["1", "2"], "z")], "i array<string>, s array<string>, x string")
    with pytest.raises(Exception, match="not in the ranked list"):
        ranking.promote_assigned(df, "i", "s", "x").collect()


def test_dedup_needs_one_direction(spark):
    df = spark.createDataFrame([(1, 2, 3)], "k int, a int, b int")
    with pytest.raises(ValueError):
        ranking.dedup_latest(df, ["k"], ["-a", "b"])


@pytest.mark.parametrize("score,d1,d2,p", [
    (4.9646, 1, 10, 0.05), (3.4928, 2, 20, 0.05), (6.6349, 1, 1e9, 0.01), (0.0, 3, 5, 1.0)])
def test_f_tail(score, d1, d2, p):
    assert f_tail(score, d1, d2) == pytest.approx(p, rel=2e-4)


@pytest.mark.parametrize("score,dof,p", [(3.8415, 1, 0.05), (18.307, 10, 0.05), (0.5, 4, 0.973501), (6.635, 1, 0.01)])
def test_chi2_tail(score, dof, p):
    assert chi2_tail(score, dof) == pytest.approx(p, rel=3e-4)


def test_tails_as_columns(spark):
    """Against plain Python, over both branches, tiny and large degrees of freedom, and no score."""
    scores = [1e-9, 0.001, 0.3, 1.0, 2.5, 7.0, 40.0, 900.0, 0.0, math.inf, math.nan, None]
    f_rows = [(s, d1, d2) for s in scores for d1 in (1.0, 2.0, 7.0) for d2 in (1.0, 5.0, 60.0, 600_000.0)] + [(1.0, 1.0, 0.0)]
    got = spark.createDataFrame(f_rows, "s double, d1 double, d2 double").select(
        "s", "d1", "d2", f_pvalue(F.col("s"), F.col("d1"), F.col("d2")).alias("p")).collect()
    for r in got:
        want = f_tail(r["s"], r["d1"], r["d2"])
        assert (r["p"] is None) == math.isnan(want), r
        # near 1 the reference's 1 - x has few digits left
        near = {"abs": 2e-6} if want > 0.5 else {"rel": 1e-8, "abs": 1e-290}
        assert r["p"] is None or r["p"] == pytest.approx(want, **near), r
    c_rows = [(s, k) for s in scores for k in (1.0, 2.0, 9.0, 100.0)]
    for r in spark.createDataFrame(c_rows, "s double, k double").select(
            "s", "k", chi2_pvalue(F.col("s"), F.col("k")).alias("p")).collect():
        want = 0.0 if r["s"] == math.inf else chi2_tail(r["s"], r["k"])
        assert (r["p"] is None) == math.isnan(want), r
        assert r["p"] is None or r["p"] == pytest.approx(want, rel=1e-8, abs=1e-13), r
    z = [0.5, 1.0, 1.5, 3.0, 9.99, 10.0, 123.4, 3e5]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(log_gamma(F.col("z"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.lgamma(x) for x in z], rel=1e-10, abs=1e-11)


def test_tails_stay_in_the_jvm(spark):
    plan = spark.range(1).select(f_pvalue(F.lit(2.0), F.lit(1), F.col("id") + 5))._jdf.queryExecution().toString()
    assert "Python" not in plan
