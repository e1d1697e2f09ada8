"""Treatment-effect curves, deciles and policies.

The frames hold an outcome ``y``, a 0/1 column ``treated`` and a predicted effect
``ite``. ``by`` adds group keys (an arm, or a random order), so every curve is computed
for all groups in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from offerflow.functions.expr import hash_order
from offerflow.operators.ordered import running
from offerflow.session import few_rows, stage


def _curve(df: DataFrame, order: Sequence[str], by: Sequence[str], y: str, treated: str,
           uniform: str | None = None) -> DataFrame:
    """Running counts and outcomes of both arms in the given order."""
    t = F.col(treated).cast("double")
    base = df.select(*by, *[o.lstrip("-") for o in order], t.alias("tr"),
                     (F.col(y) * t).alias("ytr"), (F.col(y) * (1 - t)).alias("yct"))
    cum = running(base, order, by, sums=["tr", "ytr", "yct"], rank="idx", uniform=uniform)
    return cum.withColumn("ct", F.col("idx") - F.col("cum_tr"))


def _fill_start(curve: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Before the value exists for the first time it grows linearly from 0 (the row 0)."""
    first = curve.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.min("idx").alias("_i"), F.min_by(value, "idx").alias("_v"))
    first = first.select(*[F.col(b).alias(f"_b_{b}") for b in by], "_i", "_v")
    if by:
        joined = curve.join(few_rows(first), [F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in by], "left")
    else:
        row = first.first()
        joined = curve.withColumns({"_i": F.lit(row["_i"]), "_v": F.lit(row["_v"]).cast("double")})
    filled = F.coalesce(F.col(value), F.col("_v") * F.col("idx") / F.col("_i"))
    return joined.withColumn(value, filled).drop("_i", "_v", *[f"_b_{b}" for b in by])


def lift_value() -> Column:
    return (F.try_divide(F.col("cum_ytr"), F.col("cum_tr"))
            - F.try_divide(F.col("cum_yct"), F.col("ct")))


def qini_value() -> Column:
    return F.col("cum_ytr") - F.try_divide(F.col("cum_yct") * F.col("cum_tr"), F.col("ct"))


def _from_zero(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """The curve with its row 0: position 0, every value 0, no key."""
    groups = curve.select(*by).distinct() if by else curve.sparkSession.range(1).select()
    given = {**{b: F.col(b) for b in by}, "idx": F.lit(0).cast("long")}
    zero = groups.select(*[
        given.get(f.name, F.lit(0.0) if f.dataType == DoubleType() else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in curve.schema])
    return curve.unionByName(zero)


def _lift(df: DataFrame, key: str, by: Sequence[str], y: str = "y", treated: str = "treated",
          effect: str = "ite") -> DataFrame:
    curve = _curve(df, [f"-{effect}", key], by, y, treated).withColumn("lift", lift_value())
    return _fill_start(curve, "lift", by).select(*by, key, "idx", "lift")


def _gain(df: DataFrame, key: str, by: Sequence[str], normalize: bool, **cols: str) -> DataFrame:
    gain = _lift(df, key, by, **cols).withColumn("gain", F.col("lift") * F.col("idx"))
    return _normalize(gain, "gain", by, absolute=True) if normalize else gain


def cum_lift(df: DataFrame, key: str, by: Sequence[str] = (), y: str = "y",
             treated: str = "treated", effect: str = "ite") -> DataFrame:
    """Mean treated outcome minus mean control outcome among the best idx rows, from row 0."""
    return _from_zero(_lift(df, key, by, y, treated, effect), by)


def cum_gain(df: DataFrame, key: str, by: Sequence[str] = (), normalize: bool = False,
             **cols: str) -> DataFrame:
    """Lift times population, optionally over the absolute last value, from row 0."""
    return _from_zero(_gain(df, key, by, normalize, **cols), by)


def _normalize(curve: DataFrame, value: str, by: Sequence[str], absolute: bool = False) -> DataFrame:
    last = curve.groupBy(*by).agg(F.max_by(value, "idx").alias("_l"))
    last = last.select(*[F.col(b).alias(f"_b_{b}") for b in by], "_l")
    if by:
        joined = curve.join(few_rows(last), [F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in by])
    else:
        joined = curve.withColumn("_l", F.lit(last.first()[0]).cast("double"))
    scale = F.abs("_l") if absolute else F.col("_l")
    return joined.withColumn(value, F.try_divide(F.col(value), scale)).drop(
        "_l", *[f"_b_{b}" for b in by])


def qini_curve(df: DataFrame, key: str, by: Sequence[str] = (), normalize: bool = False,
               y: str = "y", treated: str = "treated", effect: str = "ite") -> DataFrame:
    """Y_t - Y_c * N_t / N_c in effect order, with the treated share, from row 0."""
    return _from_zero(_qini(df, key, by, normalize, y, treated, effect), by)


def _qini(df: DataFrame, key: str, by: Sequence[str], normalize: bool, y: str, treated: str,
          effect: str) -> DataFrame:
    curve = _curve(df, [f"-{effect}", key], by, y, treated).withColumns(
        {"qini": qini_value(), "treated_share": F.col("cum_tr") / F.col("idx")})
    curve = _fill_start(curve, "qini", by).select(*by, key, "idx", "qini", "treated_share")
    if normalize:
        curve = _normalize(_normalize(curve, "qini", by), "treated_share", by)
    return curve


def random_orders(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k copies of the rows, each with its own repeatable hash order."""
    return (df.withColumn("order_no", F.explode(F.sequence(F.lit(1), F.lit(k))))
            .withColumn("_h", hash_order([key, "order_no"], seed)))


def random_baseline(df: DataFrame, key: str, kind: str = "qini", k: int = 10, seed: int = 42,
                    by: Sequence[str] = (), y: str = "y", treated: str = "treated") -> DataFrame:
    """The mean of the same curve under k random orders, by position, from row 0."""
    keys = [*by, "order_no"]
    curve = _curve(random_orders(df, key, k, seed), ["_h", key], keys, y, treated, "_h")
    value = lift_value() if kind == "lift" else qini_value()
    filled = _fill_start(curve.withColumn(kind, value), kind, keys)
    return _from_zero(filled.groupBy(*by, "idx").agg(F.avg(kind).alias(f"random_{kind}")), by)


def auuc_score(df: DataFrame, key: str, by: Sequence[str] = (), normalize: bool = True,
               **cols: str) -> DataFrame:
    """Mean of the gain curve, its row 0 included."""
    gain = _gain(df, key, by, normalize, **cols)
    return gain.groupBy(*by).agg((F.sum("gain") / (F.count(F.lit(1)) + 1)).alias("auuc"))


def qini_score(df: DataFrame, key: str, by: Sequence[str] = (), k: int = 10, seed: int = 42,
               y: str = "y", treated: str = "treated", effect: str = "ite") -> DataFrame:
    """Mean distance between the normalised Qini curves of the model and of random order."""
    keys = [*by, "order_no"]
    # every order ends on the same total, so the curves are summed as they are and divided at the end
    model = _qini(df, key, by, False, y, treated, effect).groupBy(*by).agg(
        F.sum("qini").alias("_m"), F.count(F.lit(1)).alias("_n"), F.max_by("qini", "idx").alias("_last"))
    curve = _curve(random_orders(df, key, k, seed), ["_h", key], keys, y, treated, "_h")
    rand = _fill_start(curve.withColumn("qini", qini_value()), "qini", keys)
    rand = rand.groupBy(*by).agg((F.sum("qini") / k).alias("_r"))
    if by:
        both = model.join(rand, list(by))
    else:
        both = model.withColumn("_r", F.lit(rand.first()[0]))
    score = F.try_divide(F.col("_m") - F.col("_r"), F.col("_last")) / (F.col("_n") + 1)
    return both.select(*by, score.alias("qini_score"))


def uplift_deciles(df: DataFrame, key: str, bins: int = 10, by: Sequence[str] = (),
                   y: str = "y", treated: str = "treated", effect: str = "ite",
                   cost: str = "cost", predicted: str | None = None, actual: str | None = None,
                   match_control: bool = False, seed: int = 42) -> DataFrame:
    """Both arms sorted apart by effect and cut into equal bins; the remainder is left out.

    With ``predicted``/``actual`` a treated row counts only where they agree, and with
    ``match_control`` a bin keeps per predicted arm at most as many control rows (in hash
    order) as it has counted treated rows."""
    side = [*by, treated]
    extra = [c for c in (predicted, actual) if c]
    ranked = running(df.select(*side, key, y, effect, cost, *extra), [f"-{effect}", key], side)
    size = ranked.groupBy(*side).agg(F.floor(F.max("rn") / bins).alias("_size"))
    size = size.select(*[F.col(c).alias(f"_b_{c}") for c in side], "_size")
    binned = (ranked.join(few_rows(size), [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in side])
              .withColumn("bin", F.floor(F.try_divide(F.col("rn") - 1, F.col("_size"))).cast("int"))
              .where(F.col("bin") < bins))
    is_t = F.col(treated) == 1
    if predicted and actual:
        binned = binned.where(~is_t | (F.col(predicted) == F.col(actual)))
        if match_control:
            cell = [*by, "bin", predicted]
            quota = binned.where(is_t).groupBy(*cell).agg(F.count(F.lit(1)).alias("_q"))
            control = binned.where(~is_t).drop("rn").withColumn("_h", hash_order([key], seed))
            control = (running(control, ["_h", key], cell, uniform="_h").join(quota, cell)
                       .where(F.col("rn") <= F.col("_q")))
            cols = [*by, treated, "bin", y, effect, cost]
            binned = binned.where(is_t).select(*cols).unionByName(control.select(*cols))
    agg = []
    for name, on in (("t", is_t), ("c", ~is_t)):
        agg += [F.count(F.when(on, 1)).alias(f"{name}_num"),
                *[F.coalesce(F.sum(F.when(on, F.col(c)).cast("double")), F.lit(0.0)).alias(f"{name}_{n}")
                  for n, c in (("y", y), ("effect", effect), ("cost", cost))]]
    return binned.groupBy(*by, "bin").agg(*agg)


def decile_lift(deciles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """True lift, predicted lift and cost per bin."""
    per = lambda c: F.try_divide(F.col("c_num") * F.col(c), F.col("t_num"))
    return deciles.select(
        *by, "bin", (per("t_y") - F.col("c_y")).alias("true_lift"),
        per("t_effect").alias("predicted_lift"), F.col("t_cost").alias("total_cost"),
        F.col("t_num").alias("n_treated"), F.col("c_num").alias("n_control"))


def decile_curve(lift: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative shares of lift and cost; one small window over the bins."""
    keys = list(by) or [F.lit(0)]
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    share = lambda c: F.try_divide(F.sum(c).over(upto), F.sum(c).over(every))
    return lift.select(*by, "bin", ((F.col("bin") + 1) / bins).alias("population_share"),
                       share("true_lift").alias("lift_share"), share("total_cost").alias("cost_share"))


def aucc_auuc(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Right-edge rectangle areas of the lift share over cost and over population."""
    w = Window.partitionBy(*(list(by) or [F.lit(0)])).orderBy("bin")
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0.0))
    areas = curve.select(*by, (F.col("lift_share") * step("cost_share")).alias("_c"),
                         (F.col("lift_share") * step("population_share")).alias("_p"))
    return areas.groupBy(*by).agg(F.sum("_c").alias("aucc"), F.sum("_p").alias("auuc"))


def arms_against_control(df: DataFrame, arm: str, control: str, arms: Sequence[str]) -> DataFrame:
    """Every arm with its own copy of the control rows, keyed by ``arm_no``'s name."""
    copies = F.when(F.col(arm) == control, F.array(*[F.lit(a) for a in arms])).otherwise(
        F.array(F.col(arm)))
    return (df.where(F.col(arm).isin([control, *arms]))
            .withColumn("treated", (F.col(arm) != control).cast("int"))
            .withColumn("versus", F.explode(copies)))


def evaluate_arms(df: DataFrame, key: str, arm: str, control: str, arms: Sequence[str],
                  effects: dict[str, str], y: str = "y", cost: str = "cost", bins: int = 10,
                  k: int = 10, seed: int = 42) -> DataFrame:
    """Qini score, aucc and auuc of every arm against control, with the arm sizes."""
    rows = arms_against_control(df, arm, control, arms)
    ite = F.lit(None).cast("double")
    for a in arms:
        ite = F.when(F.col("versus") == a, F.col(effects[a])).otherwise(ite)
    rows = stage(rows.select("versus", key, "treated", F.col(y).alias("y"), F.col(cost).alias("cost"),
                             ite.alias("ite")), "arms")
    by = ["versus"]
    qini = qini_score(rows, key, by, k, seed)
    area = aucc_auuc(decile_curve(decile_lift(uplift_deciles(rows, key, bins, by), by), bins, by), by)
    size = rows.groupBy("versus").agg(F.sum("treated").alias("n_treated"))
    return qini.join(area, "versus").join(size, "versus").withColumnRenamed("versus", "arm")


def mean_over_arms(result: DataFrame) -> DataFrame:
    """The rows of :func:`evaluate_arms` and one named ``mean``: each measure's mean over the arms,
    with the treated of all."""
    measures = ["qini_score", "aucc", "auuc"]
    mean = result.agg(*[F.avg(m).alias(m) for m in measures], F.sum("n_treated").alias("n_treated"))
    return result.unionByName(mean.select(F.lit("mean").alias("arm"), *measures, "n_treated"))


def pmg(df: DataFrame, actual: str, predicted: str, label: str) -> DataFrame:
    """Policy mean gain: label mean where the recommended arm was the actual one, weighted
    by how often each arm is recommended, relative to the overall mean."""
    per = df.groupBy(predicted).agg(
        F.avg(F.when(F.col(predicted) == F.col(actual), F.col(label))).alias("_m"),
        F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_s"), F.count(label).alias("_k"))
    matched = F.col("_m").isNotNull()
    return per.agg(
        F.try_divide(F.sum(F.when(matched, F.col("_m") * F.col("_n"))), F.sum(F.when(matched, F.col("_n"))))
        .alias("policy_mean"),
        F.try_divide(F.sum("_s"), F.sum("_k")).alias("overall_mean"),
    ).withColumn("pmg", F.try_divide(F.col("policy_mean") - F.col("overall_mean"), F.col("overall_mean")))


def best_arm(effects: Sequence[str]) -> Column:
    """Index of the best arm; control is index 0 with effect 0, ties go to the lowest index."""
    pairs = [F.struct(F.lit(0.0).alias("effect"), F.lit(0).alias("neg_idx"))]
    pairs += [F.struct(F.col(c).cast("double").alias("effect"), F.lit(-(i + 1)).alias("neg_idx"))
              for i, c in enumerate(effects)]
    return -F.array_max(F.array(*pairs))["neg_idx"]
