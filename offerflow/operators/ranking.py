"""Ranking items within a user (array work inside the row) and users within an item."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerflow.functions.expr import hash_order
from offerflow.operators.ordered import exact_quantiles, running


def dedup_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order`` (``"-x"`` = descending).

    An aggregate, not a window: each map task already keeps one row per key, so a hot key
    is never gathered. All order columns must point the same way.
    """
    down = [o.startswith("-") for o in order]
    if not order or len(set(down)) != 1:
        raise ValueError("order must be non-empty and run in one direction")
    names = [o.lstrip("-") for o in order]
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if down[0] else F.min_by
    best = df.groupBy(*keys).agg(
        pick(F.struct(*rest), F.struct(*names)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c)
                         for c in df.columns])


def rank_in_item(df: DataFrame, item: str, scores: Mapping[str, str],
                 key: str = "uid") -> DataFrame:
    """1-based rank of each user among the users of the same item, by that item's own
    score; -1 for users whose item has no score column."""
    own = F.lit(None).cast("double")
    for name, col in scores.items():
        own = F.when(F.col(item) == name, F.col(col)).otherwise(own)
    ranked = running(df.withColumn("_own", own), ["-_own", key], [item], rank="item_score_rank")
    known = F.col(item).isin(list(scores))
    return (ranked.withColumn("item_score_rank", F.when(known, F.col("item_score_rank"))
                              .otherwise(F.lit(-1).cast("long"))).drop("_own"))


def rank_items(cols: Sequence[str]) -> Column:
    """array<struct<score, idx>>, best first; of equal scores the later column comes first."""
    pairs = F.array(*[F.struct(F.col(c).cast("double").alias("score"),
                               F.lit(i).alias("idx")) for i, c in enumerate(cols)])
    return F.sort_array(pairs, asc=False)


def item_names(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(i) for i in items])


def item_sequence(df: DataFrame, cols: Sequence[str], skus: Mapping[str, Sequence[str]],
                  seed: int | str, key: str = "uid") -> DataFrame:
    """Ordered SKU list and score list per user; one SKU per item is picked by hash."""
    names = list(skus)
    picks = []
    for name in names:
        choice = skus[name]
        at = F.pmod(hash_order([F.col(key), F.lit(name)], seed), F.lit(len(choice))).cast("int")
        picks.append(F.get(item_names(choice), at))
    table = F.array(*picks)
    ranked = rank_items(cols)
    return (df.select(key, ranked.alias("_r"), table.alias("_s"))
            .select(key,
                    F.array_join(F.transform("_r", lambda x: F.get(F.col("_s"), x["idx"])), "-")
                    .alias("seq_item_sku"),
                    F.array_join(F.transform("_r", lambda x: F.format_string("%.10f", x["score"])),
                                 "-").alias("seq_item_score")))


def top_item(cols: Sequence[str], items: Sequence[str], codes: Sequence[int],
             threshold: float | None = None, flag: Column | None = None,
             fallback: tuple[str, int] = ("none", 999)) -> tuple[Column, Column]:
    """(item, code) of the best score; below ``threshold`` with ``flag`` = 0 the fallback."""
    best = rank_items(cols)[0]
    item, code = F.get(item_names(items), best["idx"]), F.get(
        F.array(*[F.lit(c) for c in codes]), best["idx"])
    if threshold is None:
        return item, code
    low = best["score"] < threshold
    if flag is not None:
        low = low & (flag == 0)
    return (F.when(low, F.lit(fallback[0])).otherwise(item),
            F.when(low, F.lit(fallback[1])).otherwise(code))


def promote(seq: Column, pos: Column) -> Column:
    """Move the 1-based position to the front, keep the order of the rest."""
    return F.concat(F.slice(seq, pos, F.lit(1)), F.slice(seq, F.lit(1), pos - 1),
                    F.slice(seq, pos + 1, F.size(seq)))


def promote_assigned(df: DataFrame, items: str, scores: str, assigned: str) -> DataFrame:
    """Assigned item first in both lists. Users without an assignment keep their order."""
    pos = F.array_position(F.col(items), F.col(assigned)).cast("int")
    keep = F.col(assigned).isNull()
    wrong = ~keep & (pos == 0)
    message = F.concat(F.lit("assigned item is not in the ranked list: "), F.col(assigned))
    at = F.when(wrong, F.raise_error(message).cast("int")).otherwise(pos)
    return df.withColumn("_pos", at).withColumns({
        items: F.when(keep, F.col(items)).otherwise(promote(F.col(items), F.col("_pos"))),
        scores: F.when(keep, F.col(scores)).otherwise(promote(F.col(scores), F.col("_pos"))),
    }).drop("_pos")


def true_item_rank(cols: Sequence[str], true_idx: Column) -> Column:
    """0-based rank of the chosen item: how many items beat it, later columns winning ties."""
    own = F.get(F.array(*[F.col(c).cast("double") for c in cols]), true_idx)
    beats = F.lit(0)
    for i, c in enumerate(cols):
        better = (F.col(c) > own) | ((F.col(c) == own) & (F.lit(i) > true_idx))
        beats = beats + F.when(better, 1).otherwise(0)
    return F.when(own.isNotNull(), beats)


def oversample_to(df: DataFrame, item: str, ref_item, tail: Sequence) -> DataFrame:
    """Tail items repeated floor(n_ref / n_item) times; other rows unchanged."""
    counts = df.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    wanted = counts.where(F.col(item).isin([ref_item, *tail])).collect()
    n = {r[item]: r["n"] for r in wanted}
    times = F.lit(1)
    for t in tail:
        if t in n:
            times = F.when(F.col(item) == t, F.lit(n.get(ref_item, 0) // n[t])).otherwise(times)
    return (df.withColumn("_times", times).where(F.col("_times") > 0)
            .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_times"))))
            .drop("_times"))


def top_features(importance: DataFrame, k: int | None = None,
                 threshold: float | None = None) -> DataFrame:
    """Importances sorted, optionally above a threshold, optionally the best k."""
    out = importance
    if threshold is not None:
        out = out.where(F.col("importance") > threshold)
    out = out.orderBy(F.col("importance").desc(), "feature")
    return out.limit(k) if k else out


def importance_deciles(importance: DataFrame) -> DataFrame:
    """0 %, 10 % .. 100 % points of the importances."""
    probs = [i / 10 for i in range(11)]
    q = exact_quantiles(importance, ["importance"], probs)
    return q.select(F.inline(F.array(*[
        F.struct(F.lit(i * 10).alias("percent"), F.col(f"q{i}").alias("importance"))
        for i in range(11)])))
