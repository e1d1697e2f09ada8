"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a target number of words. It is fitted from a histogram of exact document
lengths, where each document may be taken up to ``limit`` times: an equal share of every
length, then a bounded-knapsack dynamic programme for what remains. Seeded ranks then deal
each length's copies over its documents, no two of which differ by more than one copy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerflow.llm.common import KEY, WORD, group_key, pick_rows, row_key, text_of
from offerflow.operators.ordered import running
from offerflow.session import stage

#: Words that the dynamic programme fits exactly; beyond, lengths are added by largest remainder.
FIT_WORDS = 65_536


def _knapsack(sizes: np.ndarray, spare: np.ndarray, room: int) -> np.ndarray:
    """Bounded knapsack: how many of each size, at most ``spare``, for the largest sum up to
    ``room``. Reachable sums are the bits of a long integer; sizes enter in binary pieces."""
    out = np.zeros(len(sizes), dtype=np.int64)
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for i in range(len(sizes)):
        many = min(int(spare[i]), room // int(sizes[i])) if 0 < sizes[i] <= room else 0
        piece = 1
        while many > 0 and not reach >> room & 1:
            take = min(piece, many)
            steps.append((reach, i, take))
            reach |= (reach << (take * int(sizes[i]))) & mask
            many -= take
            piece *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for before, i, take in reversed(steps):
        if not before >> at & 1:
            out[i] += take
            at -= take * int(sizes[i])
    return out


def fit_lengths(sizes: np.ndarray, counts: np.ndarray, budget: int, fit: int = FIT_WORDS) -> np.ndarray:
    """How many documents of each size to take for a total of at most ``budget``, close to it.

    An equal share of every size comes first, then the sizes with the largest remainders until
    at most ``fit`` words are left, then the bounded knapsack; where it has no exact fit, up to 16
    copies of the share enter it too."""
    order = np.argsort(sizes, kind="stable")
    n, c = sizes[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((n * c).sum())
    if budget >= total:
        out = c.copy()
    else:
        share = c * (max(budget, 0) / total) if total else c * 0.0
        out = np.minimum(np.floor(share).astype(np.int64), c)
        out[n <= 0] = 0
        left = budget - int((n * out).sum())
        for i in np.argsort(-(share - np.floor(share)), kind="stable"):
            if left <= fit:
                break
            if 0 < n[i] <= left and out[i] < c[i]:
                out[i] += 1
                left -= int(n[i])
        while left > fit:  # only where single documents are longer than what remains
            usable = np.flatnonzero((n > 0) & (n <= left) & (out < c))
            if not len(usable):
                break
            i = usable[-1]
            more = min(int(c[i] - out[i]), left // int(n[i]))
            out[i] += more
            left -= more * int(n[i])
        left = min(left, fit)
        more = _knapsack(n, c - out, left)
        if int((n * more).sum()) < left:  # no exact fit: a few copies of the share may give way
            freed, room = out.copy(), left
            for i in np.repeat(np.arange(len(n)), np.minimum(out, 2))[:16]:
                if n[i] > 0 and room + n[i] <= fit:
                    freed[i] -= 1
                    room += int(n[i])
            other = _knapsack(n, c - freed, room)
            if room - int((n * other).sum()) < left - int((n * more).sum()):
                out, more = freed, other
        out = out + more
    back = np.empty_like(out)
    back[order] = out
    return back


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """Target per source from (_src, source_size): sources by code point, null last, weigh
    ``weights`` in turn and share ``share`` of all words; a target stops at ``limit`` times its
    source, and the excess goes to the others by weight until none is above.

    That is the level L with sum(min(limit * size, L * weight)) = budget, found by running sums
    over sources ordered by limit * size / weight. One row per source passes one task."""
    by_name = Window.orderBy(F.col("_src") == "", F.col("_src").cast("binary"))
    everything = Window.partitionBy()
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rn") - 1) % len(weights))
    rows = (sizes.withColumn("_rn", F.row_number().over(by_name)).withColumn("_w", w)
            .withColumn("_cap", F.col("source_size") * F.lit(float(limit)))
            .withColumn("_ratio", F.col("_cap") / F.col("_w"))
            .withColumn("_budget", F.lit(float(share)) * F.sum("source_size").over(everything))
            .withColumn("_all_w", F.sum("_w").over(everything)))
    earlier = Window.orderBy("_ratio", "_rn").rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.col("_budget") - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0)))
             / (F.col("_all_w") - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0))))
    rows = rows.withColumn("_level", level)
    fits = F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rn", "_level"))
    rows = rows.withColumn("_l", F.min(fits).over(everything)["_level"])
    target = F.when(F.col("_l").isNull(), F.col("_cap")).otherwise(
        F.least(F.col("_cap"), F.col("_l") * F.col("_w")))
    return rows.select("_src", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
             limit: int = 2, seed: int = 17, fit: int = FIT_WORDS, doc_id: str = "doc_id",
             text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: the row key, doc_id, size (words), source_size, target (of its
    source), taken (words the mix takes) and copies (taken / size).

    Null text has size 0 and is taken never; a null source is a source of its own, after all
    others; repeated rows are documents of their own; an empty table gives no rows. The same
    table and seed give the same mix. Documents are ranked by a seeded hash within source and
    length; the ranks come from a range partitioning, so a hot length is many tasks."""
    rows = docs.select(*row_key(docs, doc_id), F.col(f"`{doc_id}`").alias("doc_id"),
                       group_key(f"`{source}`").alias("_src"),
                       F.regexp_count(text_of(f"`{text}`"), F.lit(WORD)).cast("long").alias("size"))
    sized = stage(rows.withColumn("_hash", F.xxhash64(F.lit(seed), *KEY)), "mix-sizes")
    lengths = sized.groupBy("_src", "size").agg(F.count(F.lit(1)).alias("count"))
    targets = source_targets(
        lengths.groupBy("_src").agg(F.sum(F.col("size") * F.col("count")).alias("source_size")),
        weights, share, limit)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        places = pdf["count"].to_numpy() * int(limit)
        fits = fit_lengths(pdf["size"].to_numpy(), places, int(round(pdf["target"].iloc[0])), fit)
        return pdf.assign(many=fits)

    plan = lengths.join(targets, "_src").groupBy("_src").applyInPandas(
        fitted, "_src string, size long, count long, source_size long, target double, many long")
    plan = stage(plan, "mix-lengths")
    ranked = running(sized, ["_hash", "doc_id"], by=["_src", "size"], rank="_rank")
    taken = ranked.join(plan, ["_src", "size"])
    copies = F.floor(F.col("many") / F.col("count")) + F.when(
        F.col("_rank") <= F.col("many") % F.col("count"), 1).otherwise(0)
    return taken.select(*KEY, "doc_id", "size", "source_size", "target",
                        (copies * F.col("size")).cast("long").alias("taken"),
                        copies.cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", **settings) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as :func:`mix_plan` takes it."""
    return pick_rows(docs, mix_plan(docs, doc_id=doc_id, **settings), "copies", doc_id)
