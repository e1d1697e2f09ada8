"""Upper tails of the F and chi-square distributions as column expressions.

Both are continued fractions or series that converge geometrically; a fold over a fixed number of
terms evaluates them, and a fold that has converged keeps its value. Nothing leaves the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of a fraction; the fold stops changing where a term no longer matters.
TERMS = 400
TINY = 1e-300
CLOSE = 1e-15


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: the asymptotic series ten steps up, and down again."""
    def series(y: Column) -> Column:
        return ((y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y)
                + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7))))

    def lowered(x: Column) -> Column:
        steps = F.lit(1.0)
        for k in range(10):
            steps = steps * (x + k)
        return F.when(x >= 10, series(x)).otherwise(series(x + 10) - F.ln(steps))

    return let(z.cast("double"), lowered)


def _apart(x: Column) -> Column:
    """Moved off zero, so that it can divide."""
    return F.when(F.abs(x) > TINY, x).otherwise(F.lit(TINY))


def _folded(first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """h after the terms: the state is (c, d, h, done), a finished one stays as it is."""
    def next_(state: Column, m: Column) -> Column:
        return F.when(state["done"], state).otherwise(step(state, m.cast("double")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, next_, lambda s: s["h"])


def _state(c: Column, d: Column, h: Column, done: Column) -> Column:
    return F.struct(c.alias("c"), d.alias("d"), h.alias("h"), done.alias("done"))


def _turn(state: Column, num: Column) -> Column:
    """One partial fraction with numerator ``num`` by the modified Lentz rule."""
    def with_d(d: Column) -> Column:
        return let(_apart(1 + num / state["c"]), lambda c: _state(c, d, state["h"] * d * c, F.abs(d * c - 1) < CLOSE))

    return let(1 / _apart(1 + num * state["d"]), with_d)


def beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the regularised incomplete beta function."""
    def step(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return let(_turn(state, even), lambda s: _turn(s, odd))

    d = 1 / _apart(1 - (a + b) * x / (a + 1))
    return let(d, lambda d0: _folded(_state(F.lit(1.0), d0, d0, F.lit(False)), step))


def _beta_tail(s: Column) -> Column:
    """I_x(a, b), with y = 1 - x given apart so that neither end loses digits."""
    a, b, x, y = s["a"], s["b"], s["x"], s["y"]
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(y))
    return F.when(x <= 0, 0.0).when(y <= 0, 1.0).when(
        x < (a + 1) / (a + b + 2), front * beta_fraction(a, b, x) / a).otherwise(1 - front * beta_fraction(b, a, y) / b)


def f_pvalue(score: Column, d1: Column, d2: Column) -> Column:
    """P(F(d1, d2) > score): null without a score or degrees of freedom, 0 for infinity."""
    s, d1, d2 = score.cast("double"), d1.cast("double"), d2.cast("double")
    known = s.isNotNull() & ~F.isnan(s) & (d1 > 0) & (d2 > 0)
    place = F.struct((d2 / 2).alias("a"), (d1 / 2).alias("b"), (d2 / (d2 + d1 * s)).alias("x"), (d1 * s / (d2 + d1 * s)).alias("y"))
    return F.when(known & (s == math.inf), 0.0).when(known & (s <= 0), 1.0).when(known, let(place, _beta_tail))


def _gamma_tail(p: Column) -> Column:
    a, x = p["a"], p["x"]
    front = F.exp(a * F.ln(x) - x - log_gamma(a))

    def more(state: Column, n: Column) -> Column:  # a series term, kept in d; the sum in h
        return let(state["d"] * x / (a + n), lambda t: _state(
            state["c"], t, state["h"] + t, F.abs(t) <= F.abs(state["h"]) * CLOSE))

    def step(state: Column, m: Column) -> Column:
        num, b = -m * (m - a), x + 1 - a + 2 * m

        def with_d(d: Column) -> Column:
            return let(_apart(b + num / state["c"]), lambda c: _state(c, d, state["h"] * d * c, F.abs(d * c - 1) < CLOSE))

        return let(1 / _apart(b + num * state["d"]), with_d)

    series = 1 - front * _folded(_state(F.lit(1.0), 1 / a, 1 / a, F.lit(False)), more)
    d = 1 / (x + 1 - a)
    return F.when(x < a + 1, series).otherwise(front * _folded(_state(F.lit(1 / TINY), d, d, F.lit(False)), step))


def chi2_pvalue(score: Column, dof: Column) -> Column:
    """P(chi-square(dof) > score), by a series below dof + 2 and a fraction above; null without a score
    or degrees of freedom."""
    s, k = score.cast("double"), dof.cast("double")
    known = s.isNotNull() & ~F.isnan(s) & (k > 0)
    return F.when(known & (s == math.inf), 0.0).when(known & (s <= 0), 1.0).when(
        known, let(F.struct((k / 2).alias("a"), (s / 2).alias("x")), _gamma_tail))
