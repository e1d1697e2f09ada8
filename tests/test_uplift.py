import numpy as np
import pandas as pd
import pytest

from offerflow.operators import effects, uplift


def frame(n=60, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"uid": np.arange(n), "ite": rng.permutation(n) / n, "treated": (rng.random(n) < 0.6).astype(int)})
    pdf["y"] = (rng.random(n) < 0.3 + 0.4 * pdf.ite * pdf.treated).astype(int)
    pdf["cost"] = pdf.treated * rng.integers(1, 4, n) / 2.0
    return pdf


def curves(pdf):
    """Running curves over the effect order with a row 0, gaps filled linearly."""
    s = pdf.sort_values("ite", ascending=False)
    t, y = s.treated.to_numpy(float), s.y.to_numpy(float)
    ct, cc = t.cumsum(), (1 - t).cumsum()
    yt, yc = (y * t).cumsum(), (y * (1 - t)).cumsum()
    with np.errstate(all="ignore"):
        lift, qini = yt / ct - yc / cc, yt - yc * ct / cc
    fill = lambda v: pd.Series(np.r_[0.0, v]).interpolate().to_numpy()
    return fill(lift), fill(qini)


def test_curves(spark):
    pdf = frame()
    lift, qini = curves(pdf)
    df = spark.createDataFrame(pdf)
    got = [r["lift"] for r in uplift.cum_lift(df, "uid").orderBy("idx").collect()]
    assert np.allclose(got, lift)
    got = [r["qini"] for r in uplift.qini_curve(df, "uid").orderBy("idx").collect()]
    assert np.allclose(got, qini)
    gain = lift * np.arange(len(lift))
    assert uplift.auuc_score(df, "uid").first()["auuc"] == pytest.approx(np.mean(gain / abs(gain[-1])))


def test_curves_by_group_equal_single_curves(spark):
    a, b = frame(40, 2), frame(50, 3)
    both = spark.createDataFrame(pd.concat([a.assign(g="a"), b.assign(g="b")]))
    for g, pdf in (("a", a), ("b", b)):
        want = curves(pdf)[1]
        rows = uplift.qini_curve(both, "uid", ["g"]).where(f"g = '{g}'").orderBy("idx").collect()
        assert np.allclose([r["qini"] for r in rows], want)


def test_deciles_drop_the_remainder(spark):
    pdf = frame(67, 5)
    rows = {r["bin"]: r for r in uplift.uplift_deciles(spark.createDataFrame(pdf), "uid", bins=5).collect()}
    for side, name in ((1, "t"), (0, "c")):
        s = pdf[pdf.treated == side].sort_values("ite", ascending=False)
        size = len(s) // 5
        for b in range(5):
            part = s[b * size:(b + 1) * size]
            assert rows[b][f"{name}_num"] == len(part)
            assert rows[b][f"{name}_effect"] == pytest.approx(part.ite.sum())
            assert rows[b][f"{name}_cost"] == pytest.approx(part.cost.sum())


def test_too_few_rows_for_the_bins(spark):
    assert uplift.uplift_deciles(spark.createDataFrame(frame(6)), "uid").collect() == []


def test_pmg_drops_arms_that_never_match(spark):
    rows = [("a", "a", 1), ("a", "b", 0), ("b", "a", 0), ("c", "c", 1), ("b", "d", 1)]
    df = spark.createDataFrame(rows, "actual string, pred string, y int")
    got = uplift.pmg(df, "actual", "pred", "y").first()
    # a: mean 1 over 2 recommendations, c: mean 1 over 1; b and d never match
    assert got["policy_mean"] == pytest.approx(1.0) and got["pmg"] == pytest.approx((1 - 0.6) / 0.6)


def test_best_arm_ties(spark):
    df = spark.createDataFrame([(0.2, 0.2), (-1.0, -0.5), (0.0, 0.0), (0.1, 0.3)], "a double, b double")
    assert [r["k"] for r in df.select(uplift.best_arm(["a", "b"]).alias("k")).collect()] == [1, 0, 0, 2]


def brute_tree(pdf, depth, leaf, at=1):
    """Nested (split, n, score, children)."""
    def score(p):
        t, c = p[p.treated == 1], p[p.treated == 0]
        return (t.y.mean() - c.y.mean()) / (t.cost.mean() - c.cost.mean())

    values = np.unique(pdf.x)
    if len(values) > 10:
        values = np.unique(np.percentile(pdf.x, [3, 5, 10, 20, 30, 50, 70, 80, 90, 95, 97]))
    own, best, top = score(pdf), None, 0.0
    for v in values:
        a, b = pdf[pdf.x >= v], pdf[pdf.x < v]
        if min(len(a), len(b)) < leaf or a.treated.nunique() < 2 or b.treated.nunique() < 2:
            continue
        gain = max(score(a), score(b)) - own
        if gain > top:
            best, top = (v, a, b), gain
    if best is None or at >= depth:
        return [(None, len(pdf), round(own, 9))]
    v, a, b = best
    return [(v, len(pdf), round(own, 9)), *brute_tree(a, depth, leaf, at + 1), *brute_tree(b, depth, leaf, at + 1)]


@pytest.mark.parametrize("levels", [8, 200])
def test_uplift_tree_equals_brute_force(spark, levels):
    pdf = frame(800, 7)
    pdf["x"] = np.floor(pdf.ite * levels)
    got = effects.uplift_tree(spark.createDataFrame(pdf), "x", "treated", "y", "cost", depth=4, min_leaf=40).collect()
    flat = sorted((None if r["split"] is None else float(r["split"]), r["n"], round(r["score"], 9)) for r in got
                  if r["split"]) + sorted((r["n"], round(r["score"], 9)) for r in got if not r["split"])
    want = brute_tree(pdf, 4, 40)
    assert flat == sorted(w for w in want if w[0] is not None) + sorted(w[1:] for w in want if w[0] is None)


def test_text_tree_splits_off_the_responsive_value(spark):
    pdf = frame(600, 8)
    pdf["x"] = np.where(pdf.uid % 4 == 0, "hot", np.where(pdf.uid % 4 == 1, "warm", "cold"))
    pdf["y"] = ((pdf.x == "hot") & (pdf.treated == 1)).astype(int)
    rows = effects.uplift_tree(spark.createDataFrame(pdf), "x", "treated", "y", depth=2, min_leaf=30).collect()
    assert rows[0]["split"] == "hot" and {r["side"] for r in rows[1:]} == {"=", "<>"}


def test_dml_finds_a_constant_effect(spark):
    rng = np.random.default_rng(3)
    n = 6000
    x = rng.normal(size=n)
    t = (rng.random(n) < 1 / (1 + np.exp(-x))).astype(int)
    y = (rng.random(n) < 0.3 + 0.1 * np.tanh(x) + 0.2 * t).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"uid": np.arange(n), "x": x, "arm": np.where(t, "t", "c"), "y": y}))
    row = effects.dml_effect(df, "uid", ["x"], "arm", "c", ["t"], "y").first()
    assert abs(row["effect"] - 0.2) < 4 * row["std_error"] and 0.005 < row["std_error"] < 0.03


def test_propensity_is_clipped(spark):
    pdf = frame(400, 4)
    pdf["arm"] = np.where(pdf.ite > 0.5, "t", "c")
    out = effects.propensity(spark.createDataFrame(pdf), "uid", ["ite"], "arm", "c", ["t"], folds=2, grid=[1e-4, 1e-2])
    p = np.array([r["p_t"] for r in out.orderBy("uid").collect()])
    assert len(p) == 400 and p.min() >= 1e-3 and p.max() <= 1 - 1e-3
    assert p[pdf.ite > 0.8].min() > p[pdf.ite < 0.2].max()
