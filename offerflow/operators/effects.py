"""Treatment-effect models: propensities, X-learner, residual regression, uplift tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerflow.operators.ordered import quantiles_of_counts
from offerflow.operators.split import stratified_kfold
from offerflow.session import stage

CLIP = (1e-3, 1 - 1e-3)
# fixed percentiles tried as cuts when a node has more than ten distinct values
CUT_PERCENTILES = [3, 5, 10, 20, 30, 50, 70, 80, 90, 95, 97]


def _features(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    filled = df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(filled)


def clip_probability(p: Column) -> Column:
    return F.greatest(F.lit(CLIP[0]), F.least(F.lit(CLIP[1]), p))


def propensity(df: DataFrame, key: str, cols: Sequence[str], arm: str, control, arms: Sequence,
               folds: int = 5, grid: Sequence[float] = (1e-4, 1e-3, 1e-2, 1e-1), seed: int = 1) -> DataFrame:
    """P(arm | x) against control per arm: elastic-net regression of the arm indicator, its
    strength cross-validated, clipped away from 0 and 1. One column per arm, all rows."""
    data = stage(_features(df, cols, [key, arm]).drop(*cols), "propensity")
    out = data.select(key, "features")
    for a in arms:
        pair = data.where(F.col(arm).isin([control, a])).select(
            "features", (F.col(arm) == a).cast("double").alias("w"))
        model = LinearRegression(labelCol="w", elasticNetParam=0.5, predictionCol=f"_p_{a}")
        search = CrossValidator(
            estimator=model, numFolds=folds, seed=seed,
            estimatorParamMaps=ParamGridBuilder().addGrid(model.regParam, list(grid)).build(),
            evaluator=RegressionEvaluator(labelCol="w", predictionCol=f"_p_{a}", metricName="mse"))
        out = search.fit(pair).bestModel.transform(out)
    return out.select(key, *[clip_probability(F.col(f"_p_{a}")).alias(f"p_{a}") for a in arms])


def blend_effects(propensity: Column, effect_control: Column, effect_treated: Column) -> Column:
    """Propensity-weighted X-learner blend."""
    return propensity * effect_control + (F.lit(1.0) - propensity) * effect_treated


def x_learner(df: DataFrame, key: str, cols: Sequence[str], arm: str, control, arms: Sequence, y: str,
              shares: dict, depth: int = 3, rounds: int = 5, seed: int = 1) -> DataFrame:
    """Effect of each arm per row, one column ``ite_<arm>`` per arm.

    Outcome models per arm, imputed effects on the other side's rows, effect models on
    those, blended by the propensity (a constant per arm in ``shares``)."""
    data = stage(_features(df, cols, [key, arm, y]).drop(*cols), "xlearner")

    def outcome(rows: DataFrame, name: str):
        model = GBTClassifier(labelCol=y, maxDepth=depth, maxIter=rounds, seed=seed).fit(rows)
        return lambda x: model.transform(x).withColumn(f"mu_{name}", vector_to_array("probability")[1]).drop(
            "prediction", "rawPrediction", "probability")

    def effect(rows: DataFrame, name: str):
        return GBTRegressor(labelCol="d", maxDepth=depth, maxIter=rounds, seed=seed, predictionCol=name).fit(rows)

    base = data.where(F.col(arm) == control)
    mu_control = outcome(base, "control")
    out = data.select(key, "features")
    for a in arms:
        treated = data.where(F.col(arm) == a)
        mu_arm = outcome(treated, "arm")
        on_treated = mu_control(treated).select("features", (F.col(y) - F.col("mu_control")).alias("d"))
        on_control = mu_arm(base).select("features", (F.col("mu_arm") - F.col(y)).alias("d"))
        out = effect(on_treated, "_dt").transform(effect(on_control, "_dc").transform(out))
        out = out.withColumn(f"ite_{a}", blend_effects(
            F.lit(float(shares[a])), F.col("_dc"), F.col("_dt"))).drop("_dt", "_dc")
    return out.drop("features")


def dml_effect(df: DataFrame, key: str, cols: Sequence[str], arm: str, control, arms: Sequence, y: str,
               folds: int = 2, seed: int = 1) -> DataFrame:
    """Cross-fitted residual-on-residual effect of each arm, with its standard error.

    Outcome and treatment are predicted by logistic models fitted on the other folds; the
    effect is the ratio of two weighted sums over the residuals."""
    folded = stratified_kfold(df.select(key, arm, y, *cols), [key], arm, folds, seed)
    data = stage(_features(folded, cols, [key, arm, y, "fold"]).drop(*cols), "dml")
    sums = None
    for a in arms:
        pair = data.where(F.col(arm).isin([control, a])).withColumn("t", (F.col(arm) == a).cast("double"))
        for i in range(folds):
            train, test = pair.where(F.col("fold") != i), pair.where(F.col("fold") == i)
            for target, name in ((y, "_y"), ("t", "_t")):
                model = LogisticRegression(labelCol=target, regParam=1e-3, predictionCol=f"{name}c",
                                           rawPredictionCol=f"{name}r", probabilityCol=f"{name}p").fit(train)
                test = model.transform(test)
            part = test.select(F.lit(a).alias("arm"),
                               (F.col(y) - vector_to_array("_yp")[1]).alias("ry"),
                               (F.col("t") - vector_to_array("_tp")[1]).alias("rt"))
            sums = part if sums is None else sums.unionByName(part)
    moments = sums.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("rt") * F.col("ry")).alias("ty"),
        F.sum(F.col("rt") * F.col("rt")).alias("tt"),
        F.sum(F.pow("rt", F.lit(2)) * F.pow("ry", F.lit(2))).alias("ttyy"),
        F.sum(F.pow("rt", F.lit(3)) * F.col("ry")).alias("tttry"), F.sum(F.pow("rt", F.lit(4))).alias("tttt"))
    theta = F.col("ty") / F.col("tt")
    meat = F.col("ttyy") - 2 * theta * F.col("tttry") + theta * theta * F.col("tttt")
    return moments.select("arm", "n", theta.alias("effect"), (F.sqrt(meat) / F.col("tt")).alias("std_error"))


# --- one-feature uplift tree ---------------------------------------------------------

STATS = ["n_t", "n_c", "y_t", "y_c", "k_t", "k_c"]


def _score(s: dict, has_cost: bool) -> float | None:
    if not s["n_t"] or not s["n_c"]:
        return None
    gain = s["y_t"] / s["n_t"] - s["y_c"] / s["n_c"]
    if not has_cost:
        return gain
    cost = s["k_t"] / s["n_t"] - s["k_c"] / s["n_c"]
    return gain / cost if cost else None


def _add(parts: Sequence[dict]) -> dict:
    return {k: sum(p[k] for p in parts) for k in STATS}


def uplift_tree(df: DataFrame, x: str, treated: str, y: str, cost: str | None = None, depth: int = 6,
                min_leaf: int = 40_000) -> DataFrame:
    """Tree over one feature whose nodes differ in treatment effect (per cost, if given).

    A numeric node is cut at its distinct values, or at eleven fixed percentiles when it
    has more than ten; a text node by one value against the rest. The best cut has the
    largest gain max(child score) - node score; both children need both arms and
    ``min_leaf`` rows. The table is folded to distinct values once; a level of the tree is
    two aggregates for all its nodes. Returns one row per node."""
    spark = df.sparkSession
    numeric = dict(df.dtypes)[x] != "string"
    is_t = F.col(treated) == 1
    k = F.col(cost).cast("double") if cost else F.lit(0.0)
    value = F.col(x).cast("double") if numeric else F.col(x)
    side = lambda on, c: F.sum(F.when(on, c).otherwise(F.lit(0.0)))
    cells = stage(df.where(F.col(x).isNotNull()).groupBy(value.alias("x")).agg(
        side(is_t, F.lit(1.0)).alias("n_t"), side(~is_t, F.lit(1.0)).alias("n_c"),
        side(is_t, F.col(y)).alias("y_t"), side(~is_t, F.col(y)).alias("y_c"),
        side(is_t, k).alias("k_t"), side(~is_t, k).alias("k_c")), "tree")
    total = cells.agg(*[F.sum(s).alias(s) for s in STATS]).first().asDict()
    root = {"id": 1, "parent": None, "side": None, "depth": 1, "where": F.lit(True), "stats": total}
    nodes, level = [root], [root]
    while level:
        level = [n for n in level if n["depth"] < depth]
        if not level:
            break
        which = F.lit(None).cast("int")
        for i, n in enumerate(level):
            which = F.when(n["where"], F.lit(i)).otherwise(which)
        rows = cells.withColumn("node", which).where("node is not null")
        found = (_numeric_cuts if numeric else _text_cuts)(rows, level, bool(cost), min_leaf)
        nxt = []
        for i, (cut, match, rest) in found.items():
            node = level[i]
            node["split"] = cut
            hit = (F.col("x") >= cut) if numeric else (F.col("x") == cut)
            for j, (stats, cond, sign) in enumerate(((match, hit, ">=" if numeric else "="),
                                                     (rest, ~hit, "<" if numeric else "<>"))):
                nxt.append({"id": node["id"] * 2 + j, "parent": node["id"], "side": sign,
                            "depth": node["depth"] + 1, "where": node["where"] & cond, "stats": stats})
        nodes += nxt
        level = nxt
    data = [(n["id"], n["parent"], n["side"], n["depth"], None if "split" not in n else str(n["split"]),
             int(n["stats"]["n_t"] + n["stats"]["n_c"]), int(n["stats"]["n_t"]), int(n["stats"]["n_c"]),
             _score(n["stats"], bool(cost))) for n in nodes]
    return spark.createDataFrame(data, "node long, parent long, side string, depth int, split string, "
                                       "n long, n_treated long, n_control long, score double")


def _best(node: dict, candidates, has_cost: bool, min_leaf: int):
    """First candidate of the largest positive gain among (cut, match, rest)."""
    own = _score(node["stats"], has_cost)
    best, top = None, 0.0
    for cut, match, rest in candidates:
        if min(match["n_t"] + match["n_c"], rest["n_t"] + rest["n_c"]) < min_leaf:
            continue
        scores = [_score(match, has_cost), _score(rest, has_cost)]
        if own is None or None in scores:
            continue
        if max(scores) - own > top:
            best, top = (cut, match, rest), max(scores) - own
    return best


def _numeric_cuts(rows: DataFrame, level: list[dict], has_cost: bool, min_leaf: int) -> dict:
    distinct = rows.groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    counts = rows.select("node", F.col("x").alias("value"), (F.col("n_t") + F.col("n_c")).cast("long").alias("n"))
    q = quantiles_of_counts(counts, [p / 100 for p in CUT_PERCENTILES], ["node"])
    few = distinct.where("k <= 10").select("node")
    cuts: dict[int, list[float]] = {}
    for r in rows.join(few, "node", "left_semi").select("node", "x").collect():
        cuts.setdefault(r["node"], []).append(r["x"])
    for r in q.join(few, "node", "left_anti").collect():
        cuts[r["node"]] = [r[f"q{i}"] for i in range(len(CUT_PERCENTILES))]
    cuts = {n: sorted(set(c)) for n, c in cuts.items()}
    table = F.array(*[F.array(*[F.lit(float(c)) for c in cuts.get(i, [])]).cast("array<double>")
                      for i in range(len(level))])
    own = F.get(table, F.col("node"))
    band = F.size(F.filter(own, lambda c: c <= F.col("x")))
    sums: dict[int, dict[int, dict]] = {}
    for r in rows.groupBy("node", band.alias("band")).agg(*[F.sum(s).alias(s) for s in STATS]).collect():
        sums.setdefault(r["node"], {})[r["band"]] = {s: r[s] for s in STATS}
    zero = {s: 0.0 for s in STATS}
    out = {}
    for i, node in enumerate(level):
        parts = [sums.get(i, {}).get(b, zero) for b in range(len(cuts.get(i, [])) + 1)]
        options = [(c, _add(parts[j + 1:]), _add(parts[:j + 1])) for j, c in enumerate(cuts.get(i, []))]
        best = _best(node, options, has_cost, min_leaf)
        if best:
            out[i] = best
    return out


def _text_cuts(rows: DataFrame, level: list[dict], has_cost: bool, min_leaf: int) -> dict:
    """Every value is a candidate, so the gains are computed where the values are."""
    totals = {s: F.get(F.array(*[F.lit(float(n["stats"][s])) for n in level]), F.col("node")) for s in STATS}
    rest = {s: totals[s] - F.col(s) for s in STATS}
    match = {s: F.col(s) for s in STATS}

    def score(v):
        gain = F.try_divide(v["y_t"], v["n_t"]) - F.try_divide(v["y_c"], v["n_c"])
        if not has_cost:
            return gain
        return F.try_divide(gain, F.try_divide(v["k_t"], v["n_t"]) - F.try_divide(v["k_c"], v["n_c"]))

    big = lambda v: (v["n_t"] + v["n_c"] >= min_leaf) & (v["n_t"] > 0) & (v["n_c"] > 0)
    a, b = score(match), score(rest)
    gain = F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)) - score(totals)
    best = rows.where(big(match) & big(rest)).withColumn("gain", gain).where("gain > 0").groupBy("node").agg(
        F.max("gain").alias("gain"), F.min_by(F.struct("x", *STATS), F.struct((-F.col("gain")).alias("g"), "x")).alias("r"))
    out = {}
    for r in best.collect():
        hit = {s: r["r"][s] for s in STATS}
        whole = level[r["node"]]["stats"]
        out[r["node"]] = (r["r"]["x"], hit, {s: whole[s] - hit[s] for s in STATS})
    return out
