"""Whole jobs: dated tables in, one dated result partition out.

A job reads its partitions, works in Spark, and replaces the partition of its date, so running it
again leaves one copy. What it returns is read back from there."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from offerflow.functions.expr import rule_none
from offerflow.operators import profile, quotas, selection, stats
from offerflow.operators.joins import assemble_features, join_rules_scores
from offerflow.operators.scoring import Model
from offerflow.session import stage
from offerflow.sources.partitions import read_partition, write_partition


# --- scoring --------------------------------------------------------------------------------------

@dataclass(frozen=True)
class ScoringModel:
    """A model with its own features (name -> value where missing), one output column per name, and
    what is done to its scores before they are published."""

    outputs: Sequence[str]
    features: Mapping[str, float]
    load: Callable[[], Model]
    calibrate: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)


def score_models(df: DataFrame, models: Sequence[ScoringModel], keys: Sequence[str]) -> DataFrame:
    """Keys and the outputs of all models, calibrated. The table is read once: every Arrow batch
    carries the features of all models, each with its own value for missing ones, and each
    model is loaded once per task."""
    keys = list(keys)
    names = [[f"_{i}_{k}" for k in range(len(m.features))] for i, m in enumerate(models)]
    inputs = df.select(*keys, *[
        F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(float(default))).alias(name)
        for m, own in zip(models, names) for name, (c, default) in zip(own, m.features.items())])
    outputs = [o for m in models for o in m.outputs]
    if len(set(outputs)) < len(outputs) or set(outputs) & set(keys):
        raise ValueError("every output needs a name of its own")
    loaders = [(m.load, own, len(m.outputs)) for m, own in zip(models, names)]

    def run(batches):
        ready = [(load(), own, n) for load, own, n in loaders]
        for batch in batches:
            out = [np.asarray(model(batch[own].to_numpy(dtype="float64")), dtype="float64").reshape(len(batch), n)
                   for model, own, n in ready]
            yield pd.concat([batch[keys].reset_index(drop=True),
                             pd.DataFrame(np.hstack(out) if out else np.zeros((len(batch), 0)), columns=outputs)], axis=1)

    shape = StructType([*[df.schema[k] for k in keys], *[StructField(o, DoubleType()) for o in outputs]])
    scored = inputs.mapInPandas(run, shape)
    how = {o: c for m in models for o, c in m.calibrate.items()}
    return scored.select(*keys, *[how[o](F.col(o)).alias(o) if o in how else F.col(o) for o in outputs])


def scoring_models_job(spark: SparkSession, people_path: str, feature_paths: Sequence[tuple[str, Sequence[str]]],
                       out_path: str, date: str, feature_date: str, key: str, models: Sequence[ScoringModel],
                       **parts: str) -> DataFrame:
    """Scores the people of ``date`` with several models, over the features of ``feature_date``, and
    publishes one partition with the outputs of all of them. One shuffle per feature table, one
    Python pass in all."""
    people = read_partition(spark, people_path, date, [key])
    groups = [(read_partition(spark, path, feature_date, [key, *cols]), []) for path, cols in feature_paths]
    write_partition(score_models(assemble_features(people, groups, [key]), models, [key]), out_path, date, **parts)
    return read_partition(spark, out_path, date, **parts)


def blended_effects(load: Callable[[], Sequence[tuple[Model, Model]]], propensity: Sequence[float]) -> Callable[[], Model]:
    """A model with one output per arm: its effect among the treated and among the untreated, the first
    weighted by 1 - p, the second by the arm's propensity p."""
    shares = [float(p) for p in propensity]

    def loaded() -> Model:
        pairs = load()

        def effects(x: np.ndarray) -> np.ndarray:
            return np.stack([p * untreated(x) + (1 - p) * treated(x) for p, (treated, untreated) in zip(shares, pairs)], axis=1)

        return effects

    return loaded


def uplift_scoring_job(spark: SparkSession, in_path: str, out_path: str, date: str, publish_date: str, key: str,
                       features: Mapping[str, float], arms: Sequence[str],
                       load: Callable[[], Sequence[tuple[Model, Model]]], propensity: Sequence[float],
                       prefix: str = "score_") -> DataFrame:
    """Per-arm effects of the rows of ``date``, published under ``publish_date``. All arms are scored
    in the one pass over the table."""
    model = ScoringModel([f"{prefix}{a}" for a in arms], features, blended_effects(load, propensity))
    rows = read_partition(spark, in_path, date, [key, *[f for f in features if f != key]])
    write_partition(score_models(rows, [model], [key]), out_path, publish_date)
    return read_partition(spark, out_path, publish_date)


# --- allocation -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Offer:
    """Items with their codes, score columns, traffic shares and rule columns."""

    items: Sequence[str]
    codes: Sequence[int]
    scores: Sequence[str]
    ratios: Sequence[float]
    rules: Sequence[str] | None = None
    slack: float = 1.0


def allocation_job(spark: SparkSession, ids_path: str, rule_paths: Sequence[str], score_paths: Sequence[str], out_path: str,
                   date: str, key: str, group: str, groups: Sequence[int], offer: Offer, quantiles: Sequence[int] | None = None,
                   salt: str = "", n_buckets: int = 1, deciding_rules: Sequence[str] | None = None,
                   gap: float = quotas.GAP, **parts: str) -> tuple[DataFrame, DataFrame, quotas.Allocation]:
    """(rows, traffic, allocation): ids of ``date`` in the experiment ``groups``, with the rules and scores
    of that date, split into those that may get an item and those that no deciding rule lets through;
    the former are allocated, by users in salted buckets or, with ``quantiles``, by score groups. Published
    are key, rank within the item, item and code; ``rows`` is read back, ``traffic`` is its report."""
    ids = read_partition(spark, ids_path, date)
    ids = ids.where(F.col(group).isin(*groups)).select(key)
    rules = [read_partition(spark, p, date) for p in rule_paths]
    scores = [read_partition(spark, p, date) for p in score_paths]
    users = stage(join_rules_scores(ids, rules, scores, key), "job-users")
    users = users.select(key, *[c for c in users.columns if c != key])
    may = users
    if deciding_rules:
        may = users.where(~rule_none(deciding_rules).eqNullSafe(F.lit(0)))
    may = may.where(F.coalesce(*offer.scores).isNotNull()).fillna(0.0, list(offer.scores))
    if quantiles:
        assigned, allocation = quotas.allocate_groups(may, key, offer.scores, offer.ratios, offer.slack, quantiles, offer.rules, gap=gap)
    else:
        allocation = quotas.allocate_with_quotas(may, key, offer.scores, offer.ratios, offer.slack, salt, n_buckets, offer.rules, gap)
        assigned = allocation.frame
    rows, _ = quotas.quota_report(users, assigned, key, offer.items, offer.codes, offer.scores, offer.ratios)
    write_partition(rows, out_path, date, **parts)
    back = read_partition(spark, out_path, date, **parts)
    traffic = profile.traffic_report(back, "item", [*offer.items, "none"], [*offer.codes, 97], [*offer.ratios, 0.0])
    return back, traffic, allocation


# --- feature selection ------------------------------------------------------------------------------

def feature_selection(df: DataFrame, groups: Sequence[Sequence[str]], keys: Sequence[str], label: str, item: str,
                      score: Callable[[DataFrame], DataFrame], p_threshold: float = 0.05, max_missing: float = 100.0,
                      repeats: int = 1, seed: int = 1) -> DataFrame:
    """One row per feature, over all steps of a selection run: group, count, std, miss_percent, constant, score and p_value
    of the conditional test within ``item``, tested (kept by it), importance (AUC lost when
    shuffled; null if not tested), selected.

    Groups of features are profiled and tested each on its own, as they come from tables of their own; a
    feature is dropped if it is constant or missing in more than ``max_missing`` percent, tested by
    p <= ``p_threshold``, and selected if shuffling it costs the model anything. ``score`` adds
    the model's score to rows with label and features."""
    tested, known = [], None
    for number, cols in enumerate(groups):
        described = stage(profile.describe_features(df, cols).select("feature", "count", "std", "miss_percent"), "described")
        usable = [r["feature"] for r in described.where(
            (F.col("std") > 0) & (F.col("miss_percent") <= max_missing)).collect()]  # one row per feature
        usable = [c for c in cols if c in usable]
        test = stats.conditional_f(df, usable, label, item) if usable else None
        part = described.withColumn("group", F.lit(number)).withColumn("constant", F.coalesce(F.col("std") == 0, F.lit(True)))
        if test is not None:
            part = part.join(F.broadcast(test), "feature", "left")  # one row per feature
        else:
            part = part.withColumn("score", F.lit(None).cast("double")).withColumn("p_value", F.lit(None).cast("double"))
        part = stage(part.withColumn("tested", F.coalesce(F.col("p_value") <= p_threshold, F.lit(False))), "tested")
        known = part if known is None else known.unionByName(part)
        kept = {r["feature"] for r in part.where("tested").collect()}
        tested += [c for c in cols if c in kept]
    if tested:
        lost = selection.permutation_importance(df, keys, tested, label, score, seed, repeats)
        known = known.join(F.broadcast(lost), "feature", "left")
    else:
        known = known.withColumn("importance", F.lit(None).cast("double"))
    return known.select("feature", "group", "count", "std", "miss_percent", "constant", "score", "p_value", "tested", "importance",
                        (F.col("tested") & (F.coalesce("importance", F.lit(0.0)) > 0)).alias("selected"))
