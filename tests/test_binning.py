import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from offerflow.operators import binning


def column(spark, values, name="x"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


def test_right_closed_edges(spark):
    df = column(spark, [1, 2, 2, 3, 10, None, -1, 0])
    got = binning.fixed_bands([0, 2, 3, 9]).apply(df, "x").collect()
    assert [r["bin"] for r in got] == [0, 0, 0, 1, None, None, None, None]


def test_missing_band_and_labels(spark):
    df = column(spark, [1, 2, 2, 3, 10, None, -1])
    rows, bands = binning.bin_feature(df, "x", "fixed", cuts=[-math.inf, 2, 5, 7, math.inf])
    assert [r["bin"] for r in rows.collect()] == [0, 0, 0, 1, 3, -1, -1]
    labels = {r["bin"]: r["bin_range"] for r in bands.collect()}
    # band 2 is empty: band 3 starts where the last filled band ended
    assert labels == {-1: "[-1, -1]", 0: "[1.0, 2.0]", 1: "(2.0, 3.0]", 3: "(3.0, 10.0]"}


@pytest.mark.parametrize("values", [[1, 2, 3, 4, 10, 20], [5, 5, 5, 5], [1, 1, 1, 1, 2, 3, 9, 9]])
def test_equal_freq_is_qcut(spark, values):
    bands = binning.equal_freq_bands(column(spark, values), "x", 3)
    cuts = sorted(set(np.quantile(values, [0, 1 / 3, 2 / 3, 1])))
    assert np.allclose(bands.edges, cuts)
    if len(cuts) > 1:
        want = pd.qcut(values, 3, labels=False, duplicates="drop")
        assert [r["bin"] for r in bands.apply(column(spark, values), "x").collect()] == list(want)


@pytest.mark.parametrize("values", [[1, 2, 3, 4, 10, 20], [5, 5, 5], [-2, 0, 7.5]])
def test_equal_width_is_cut(spark, values):
    bands = binning.equal_width_bands(column(spark, values), "x", 4)
    _, want = pd.cut(values, 4, retbins=True)
    assert np.allclose(bands.edges, want)


def test_quantile_cut_of_a_constant_is_zero(spark):
    got = binning.quantile_cut(column(spark, [3, 3, None]), {"x": 5}).collect()
    assert [r["x_quant"] for r in got] == [0, 0, None]


def test_weighted_cuts_follow_the_running_weight(spark):
    rng = np.random.default_rng(5)
    v, w = rng.integers(0, 30, 400), rng.integers(0, 4, 400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(v, w)], "x double, w double")
    got = binning.equal_freq_bands_weighted(df, "x", "w", 5).edges[1:-1]
    rows = pd.DataFrame({"x": v, "w": w}).sort_values(["x", "w"]).reset_index(drop=True)
    cum = rows.w.cumsum()
    want = sorted({float(rows.x[cum <= np.percentile(cum, p)].iloc[-1]) for p in (20, 40, 60, 80)})
    assert list(got) == want


def brute_tree(x, y, w, max_leaf, share):
    """Plain recursion over all midpoints, and merging by least loss."""
    def gini(mask):
        total = w[mask].sum()
        return 1 - sum((w[mask & (y == c)].sum() / total) ** 2 for c in (0, 1))

    least, cuts = w.sum() * share, []

    def grow(mask):
        values = np.unique(x[mask])
        best, at = 0.0, None
        for a, b in zip(values, values[1:]):
            m = (a + b) / 2
            lo, hi = mask & (x < m), mask & (x > m)
            if min(w[lo].sum(), w[hi].sum()) < least:
                continue
            gain = gini(mask) - (w[lo].sum() * gini(lo) + w[hi].sum() * gini(hi)) / w[mask].sum()
            if gain > best + 1e-15:
                best, at = gain, m
        if at is not None:
            cuts.append(at)
            for side in (mask & (x < at), mask & (x > at)):
                if side.sum() >= least * 2:
                    grow(side)

    grow(np.ones(len(x), bool))
    cuts.sort()
    while len(cuts) + 1 > max_leaf and len(cuts) + 1 > 3:
        edges = [-np.inf, *cuts, np.inf]
        losses = []
        for i in range(len(cuts)):
            a = (x > edges[i]) & (x < edges[i + 1])
            b = (x > edges[i + 1]) & (x < edges[i + 2])
            both = w[a].sum() + w[b].sum()
            losses.append((w[a].sum() * gini(a) + w[b].sum() * gini(b)) / both - gini(a | b))
        del cuts[int(np.argmax(losses))]
    return cuts


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("max_leaf", [3, 5])
def test_tree_bands_equal_brute_force(spark, weighted, max_leaf):
    rng = np.random.default_rng(11)
    x = rng.integers(0, 60, 900).astype(float)
    y = (rng.random(900) < 0.2 + 0.5 * np.sin(x / 9) ** 2).astype(int)
    w = rng.integers(1, 4, 900).astype(float) if weighted else np.ones(900)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(x, y, w)],
                               "x double, y int, w double")
    bands = binning.tree_bands(df, "x", "y", [0, 1], max_leaf, 0.05, "w" if weighted else None)
    assert list(bands.edges[1:-1]) == brute_tree(x, y, w, max_leaf, 0.05)


def test_woe_of_a_band_without_positives(spark):
    df = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (1, 0), (2, 1)], "bin int, label int")
    got = {r["bin_index"]: r for r in binning.woe_iv(df, "bin", "label").collect()}
    assert got["1"]["woe"] is None and got["1"]["good"] is None and got["2"]["iv"] is None
    assert got["0"]["woe"] == pytest.approx(math.log(0.5 / (1 / 3)))
    assert got["total"]["iv"] == pytest.approx(got["0"]["iv"]) and got["total"]["woe"] == -9999
    assert got["0"]["lift"] == pytest.approx(round(0.5 / 0.6, 2))


@pytest.mark.parametrize("method", ["equal_freq", "equal_width", "fixed", "tree"])
def test_column_without_values(spark, method):
    df = spark.createDataFrame([(None, 1), (-1.0, 0)], "x double, y int")
    rows, bands = binning.bin_feature(df, "x", method, cuts=[0, 1], label="y")
    assert [r["bin"] for r in rows.collect()] == [-1, -1]
    assert [(r["bin"], r["n"], r["bin_range"]) for r in bands.collect()] == [(-1, 2, "[-1, -1]")]


def test_one_value_is_one_band(spark):
    rows, bands = binning.bin_feature(column(spark, [4, 4, 4]), "x", "equal_freq", n=3)
    assert [r["bin"] for r in rows.collect()] == [0, 0, 0]
    assert [r["n"] for r in bands.collect()] == [3]


def test_quantile_cut_computes_its_input_once(spark):
    source = spark.range(5000).groupBy((F.col("id") % 997).alias("k")).agg(F.sum("id").cast("double").alias("x"))
    got = binning.quantile_cut(source, {"x": 4})
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["x_quant"] for r in got.collect()} == {0, 1, 2, 3} and got.count() == 997
