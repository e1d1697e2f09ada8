"""One item per user, or per group of users, under traffic quotas; see :mod:`market` for how the
items are chosen."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerflow.functions.expr import apply_rule_weight, rule_none, salted_bucket
from offerflow.operators import binning, profile, ranking
from offerflow.operators.market import Allocation, Market
from offerflow.session import stage

#: Largest relative distance to the bound at which an allocation is taken as it is.
GAP = 1e-4


def _jitter(key: str, i: int, size: float) -> Column:
    """Deterministic tiny offset that settles equal scores."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(1 << 20)) / float(1 << 20) * size


def _caps(ratios: Sequence[float], cap) -> Callable[[Column], Column]:
    return lambda n: F.array(*[(cap(n, r) if r > 0 else F.lit(0.0)).cast("double") for r in ratios])


def allocate_with_quotas(df: DataFrame, key: str, scores: Sequence[str], ratios: Sequence[float],
                         slack: float, salt: str, n_buckets: int, rules: Sequence[str] | None = None,
                         gap: float = GAP) -> Allocation:
    """Best total score with one item per user, at most ceil(rows * ratio * slack) users per
    item and bucket, and no item whose rule is 0 (a null rule allows it).

    The value is within ``gap`` of the bound, or the prices are exact. Raises where the quotas cannot
    be met. Neither buckets nor items have a limit: prices are a table with a row per bucket."""
    cols = []
    for i, s in enumerate(scores):
        value = F.col(s).cast("double") + _jitter(key, i, 1e-9)
        if ratios[i] <= 0:
            value = F.lit(None).cast("double")
        elif rules:
            value = F.when(~F.col(rules[i]).eqNullSafe(F.lit(0)), value)
        cols.append(value.alias(f"s{i}"))
    rows = stage(df.select(key, salted_bucket(key, salt, n_buckets).cast("long").alias("bucket"),
                           F.lit(1.0).alias("w"), *cols), "quota")
    return Market(rows, key, len(scores), _caps(ratios, lambda n, r: F.ceil(n * r * slack)), unit=True).solve(gap)


def allocate_groups(df: DataFrame, key: str, scores: Sequence[str], ratios: Sequence[float], slack: float,
                    quantiles: Sequence[int], rules: Sequence[str] | None = None, eps: float = 1e-10,
                    count_weighted: bool = True, gap: float = GAP) -> tuple[DataFrame, Allocation]:
    """The grouped form: users fall into groups by the quantiles of their (rule-weighted)
    scores, each group gets one item, and the users of an item number at most
    ceil(N * ratio) * slack. Returns (users with their ``item_idx``, group allocation).

    Groups stay in a written table; prices, shifts and exchanges work on it as on users. Quotas that
    cannot be met even by splitting groups raise; ``excess`` of the allocation is not 0 where
    groups are too large for any exchange to fit them. ``count_weighted=False`` adds up group means
    without regard to the group sizes."""
    eff = df
    for i, s in enumerate(scores):
        value = F.col(s).cast("double")
        if rules:
            # no rule row: the score stands
            value = F.coalesce(apply_rule_weight(value, rules[i], eps), value)
        eff = eff.withColumn(f"_s{i}", value)
    eff = stage(eff.select(key, *[f"_s{i}" for i in range(len(scores))]), "groups")
    quants = binning.quantile_cut(eff, {f"_s{i}": n for i, n in enumerate(quantiles)}, "_q")
    coded = quants.withColumn("group_code", binning.group_code(
        [f"_s{i}_q" for i in range(len(quantiles))], quantiles))
    summary = profile.group_summary(coded, ["group_code"], [f"_s{i}" for i in range(len(scores))])
    size = F.col("n_users").cast("double") if count_weighted else F.lit(1.0)
    rows = stage(summary.select(
        "group_code", F.lit(0).cast("long").alias("bucket"), F.col("n_users").cast("double").alias("w"),
        *[(F.when(F.lit(ratios[i] > 0), F.col(f"_s{i}_mean") * size + _jitter("group_code", i, 1e-9)))
          .alias(f"s{i}") for i in range(len(scores))]), "groups")
    result = Market(rows, "group_code", len(scores), _caps(ratios, lambda n, r: F.ceil(n * r) * slack), unit=False).solve(gap)
    users = coded.select(key, "group_code").join(result.frame.select("group_code", "item_idx"), "group_code")
    return users, result


def quota_report(users: DataFrame, assigned: DataFrame, key: str, items: Sequence[str],
                 codes: Sequence[int], scores: Sequence[str], ratios: Sequence[float],
                 none: tuple[str, int] = ("none", 97)) -> tuple[DataFrame, DataFrame]:
    """(rows, traffic): every user with item, code and rank within the item; users without
    an assignment form the ineligible group, ranked -1. ``assigned`` holds key and item_idx."""
    joined = users.join(assigned.select(key, "item_idx"), key, "left")
    names = F.array(*[F.lit(i) for i in items])
    numbers = F.array(*[F.lit(int(c)) for c in codes])
    rows = joined.withColumns({
        "item": F.coalesce(F.get(names, F.col("item_idx")), F.lit(none[0])),
        "item_code": F.coalesce(F.get(numbers, F.col("item_idx")), F.lit(none[1]))})
    ranked = ranking.rank_in_item(rows, "item", dict(zip(items, scores)), key)
    traffic = profile.traffic_report(rows.select("item"), "item", [*items, none[0]],
                                     [*codes, none[1]], [*ratios, 0.0])
    return ranked.select(key, "item_score_rank", "item", "item_code"), traffic


def ordered_lists(users: DataFrame, key: str, items: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Items and printed scores (10 decimals) of each user, best first."""
    names = F.array(*[F.lit(i) for i in items])
    ranked = users.select(key, names.alias("_n"), ranking.rank_items(scores).alias("_r"))
    return ranked.select(
        key, F.transform("_r", lambda x: F.get(F.col("_n"), x["idx"])).alias("item_list"),
        F.transform("_r", lambda x: F.format_string("%.10f", x["score"])).alias("score_list"))


def sequence_rows(users: DataFrame, assigned: DataFrame, key: str, items: Sequence[str],
                  scores: Sequence[str]) -> DataFrame:
    """Ordered lists with the assigned item (column ``item``) first; users without an
    assignment keep the pure score order."""
    lists = ordered_lists(users, key, items, scores).join(assigned.select(key, "item"), key, "left")
    moved = ranking.promote_assigned(lists, "item_list", "score_list", "item")
    return moved.select(key, F.array_join("item_list", "-").alias("item_order"),
                        F.array_join("score_list", "-").alias("score_order"))


def allocate_sequence(users: DataFrame, key: str, items: Sequence[str], scores: Sequence[str],
                      listed: Sequence[str], ratios: Sequence[float], slack: float, salt: str,
                      n_buckets: int, rules: Sequence[str] | None = None,
                      listed_rules: Sequence[str] | None = None) -> DataFrame:
    """Quota allocation, then the full ordered list per user over the ``listed`` score
    columns. Quotas of items that are not listed must be 0."""
    outside = [i for i, s, r in zip(items, scores, ratios) if s not in listed and r > 0]
    if outside:
        raise ValueError(f"items with a quota are not in the ranked list: {outside}")
    eligible = users
    if listed_rules:
        eligible = users.where(~rule_none(listed_rules).eqNullSafe(F.lit(0)))
    result = allocate_with_quotas(eligible, key, scores, ratios, slack, salt, n_buckets, rules)
    names = F.array(*[F.lit(i) for i in items])
    assigned = result.frame.select(key, F.get(names, F.col("item_idx")).alias("item"))
    listed_items = [i for i, s in zip(items, scores) if s in listed]
    return sequence_rows(users, assigned, key, listed_items, list(listed))
