"""Scalar rules of the offer flow as Spark columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bucket_dates(col: Column | str, cutoffs: Sequence[tuple[str, str]],
                 default: str | None = None) -> Column:
    """First (last_day, observation_day) pair whose last_day is not before the date."""
    day = F.to_date(_c(col))
    out = F.lit(default).cast("date")
    for last, obs in reversed(sorted(cutoffs)):
        out = F.when(day <= F.lit(last).cast("date"), F.lit(obs).cast("date")).otherwise(out)
    return out


def weekday(col: Column | str) -> Column:
    """Monday is 0."""
    return F.weekday(_c(col))


def map_values(col: Column | str, mapping: Mapping, default=None) -> Column:
    """Dictionary replace for short dictionaries; long ones go through a join
    (:func:`offerflow.operators.joins.map_values_join`)."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    hit = F.element_at(table, _c(col))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def ratio(num: Column | str, den: Column | str) -> Column:
    return F.try_divide(_c(num), _c(den))


def ladder(col: Column | str, steps: Sequence[tuple[float, str]], last: str) -> Column:
    """Label of the first step whose upper bound is above the value, else ``last``."""
    out = F.lit(last)
    for bound, label in reversed(sorted(steps)):
        out = F.when(_c(col) < bound, F.lit(label)).otherwise(out)
    return F.when(_c(col).isNull(), F.lit(None)).otherwise(out)


def fill_missing(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.fillna(dict(values))


def clip_category(col: Column | str, n: int) -> Column:
    """Codes outside 0..n-1 share the last bucket n."""
    return F.when(_c(col).between(0, n - 1), _c(col)).otherwise(F.lit(n))


def apply_rule_weight(score: Column | str, rule: Column | str, eps: float = 1e-10) -> Column:
    """Soft exclusion: a rule of 0 shrinks the score to eps times itself."""
    return _c(score) * (F.lit(1.0) - (F.lit(1.0) - _c(rule)) * F.lit(1.0 - eps))


def rule_none(rules: Sequence[str]) -> Column:
    """Row maximum of the rules: 0 means nobody is eligible, null means no rules at all."""
    return F.greatest(*rules) if len(rules) > 1 else F.col(rules[0])


def combine_rules(a: Column | str, b: Column | str) -> Column:
    return _c(a).bitwiseAND(_c(b))


def combine_scores(a: Column | str, b: Column | str) -> Column:
    return _c(a) * _c(b)


def calibrate_neg_sampling(score: Column | str, rate: float) -> Column:
    """Undo down-sampling of the negatives to ``rate``."""
    s = _c(score)
    return s / (s + (F.lit(1.0) - s) / F.lit(float(rate)))


def calibrate_chain(score: Column | str, share: Column | str, rate: float) -> Column:
    """As above when only the share ``share`` of the negatives was down-sampled."""
    s, r = _c(score), _c(share)
    rest = F.lit(1.0) - s
    return s / (s + rest * (F.lit(1.0) - r) + rest * r / F.lit(float(rate)))


def ordinal_labels(label: Column | str, k: int, name: str = "label") -> list[Column]:
    """Label 0..k as k cumulative 0/1 columns ``name_ge_1 .. name_ge_k``."""
    return [F.when(_c(label) >= i, 1).otherwise(0).alias(f"{name}_ge_{i}")
            for i in range(1, k + 1)]


def funnel_probability(steps: Sequence[Column | str], floor: float = 1e-7) -> list[Column]:
    """Running product of step probabilities, floored after every step."""
    out: list[Column] = []
    for step in steps:
        p = _c(step) if not out else out[-1] * _c(step)
        out.append(F.greatest(p, F.lit(floor)))
    return out


def sample_weight(rules: Sequence[tuple[Column, float]], default: float) -> Column:
    """First matching rule gives the weight."""
    return reduce(lambda rest, rule: F.when(rule[0], F.lit(rule[1])).otherwise(rest),
                  reversed(list(rules)), F.lit(default))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def dot(u: Column | str, v: Column | str) -> Column:
    products = F.zip_with(_c(u), _c(v), lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_sigmoid(u: Column | str, v: Column | str) -> Column:
    """Sigmoid of the cosine, clipped to [-1, 1]."""
    norms = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v)) + F.lit(1e-8)
    return sigmoid(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / norms)))


def salted_bucket(uid: Column | str, salt: str, n: int) -> Column:
    """``md5(sha1(uid || salt))`` as a 128-bit number modulo n, eight hex digits at a time."""
    if not 0 < n < 2 ** 30:
        raise ValueError("n must be in 1 .. 2^30 - 1")
    digest = F.md5(F.sha1(F.concat(_c(uid).cast("string"), F.lit(salt)).cast("binary"))
                   .cast("binary"))
    acc = F.lit(0).cast("long")
    for k in range(4):
        part = F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")
        acc = F.pmod(acc * F.lit(2 ** 32 % n) + part, F.lit(n))
    return acc


def hash_order(cols: Sequence[Column | str], seed: int | str) -> Column:
    """Repeatable pseudo-random number in 0 .. 2^32-1 from the key columns and a seed."""
    text = F.concat_ws("|", *[_c(c).cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def in_list(col: Column | str, values: Sequence) -> Column:
    return _c(col).isin(list(values))
