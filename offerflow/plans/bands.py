"""Banding, weight of evidence, correlations and feature tests."""

from itertools import combinations

from pyspark.sql import functions as F

from offerflow.operators import binning, stats
from offerflow.plans.catalog import query
from offerflow.plans.scores import rounded
from offerflow.plans.views import SCORES

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K = ", ".join(KEYS)
X = ["x1", "x2", "x3", "x4"]


@query("""SELECT bin, min(x1) AS low, max(x1) AS high, count(*) AS n FROM (SELECT x1, CASE
  WHEN x1 <= 0 OR x1 > 45 THEN NULL WHEN x1 <= 10 THEN 0 WHEN x1 <= 20 THEN 1 ELSE 2 END AS bin
  FROM fx_label) WHERE bin IS NOT NULL GROUP BY bin""", ["fx_label"])
def bin_fixed(t):
    return binning.band_ranges(binning.fixed_bands([0, 10, 20, 45]).apply(t.fx_label, "x1"), "x1")


@query(f"""WITH q AS (SELECT quantile_cont(x2, [0.2, 0.4, 0.6, 0.8]) AS c FROM fx_label)
  SELECT {K}, CASE WHEN x2 <= c[1] THEN 0 WHEN x2 <= c[2] THEN 1 WHEN x2 <= c[3] THEN 2
    WHEN x2 <= c[4] THEN 3 ELSE 4 END AS bin FROM fx_label, q""", ["fx_label"])
def bin_equal_freq(t):
    bands = binning.equal_freq_bands(t.fx_label, "x2", 5)
    return bands.apply(t.fx_label, "x2").select(*KEYS, "bin")


@query("""WITH c AS (SELECT x2, sum(w) OVER (ORDER BY x2, w, l_orderkey, l_linenumber, l_partkey, l_suppkey
    ROWS UNBOUNDED PRECEDING) AS cw FROM fx_label),
  q AS (SELECT unnest(quantile_cont(cw, [0.25, 0.5, 0.75])) AS lim FROM c)
  SELECT DISTINCT (SELECT max(x2) FROM c WHERE cw <= lim) AS cut FROM q""", ["fx_label"])
def bin_equal_freq_weighted(t):
    bands = binning.equal_freq_bands_weighted(t.fx_label, "x2", "w", 4)
    return t.spark.createDataFrame([(c,) for c in bands.edges[1:-1]], "cut double")


@query(f"""WITH r AS (SELECT min(x2) AS lo, max(x2) AS hi FROM fx_label)
  SELECT {K}, CASE WHEN x2 <= lo + (hi - lo) * 1 / 4 THEN 0 WHEN x2 <= lo + (hi - lo) * 2 / 4 THEN 1
    WHEN x2 <= lo + (hi - lo) * 3 / 4 THEN 2 ELSE 3 END AS bin FROM fx_label, r""", ["fx_label"])
def bin_equal_width(t):
    bands = binning.equal_width_bands(t.fx_label, "x2", 4)
    return bands.apply(t.fx_label, "x2").select(*KEYS, "bin")


@query("""WITH v AS (SELECT x1 AS v, count(*) AS n, sum(label) AS p FROM fx_label GROUP BY x1),
  c AS (SELECT v, sum(n) OVER w AS n1, sum(p) OVER w AS p1, sum(n) OVER () AS n0, sum(p) OVER () AS p0
    FROM v WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)),
  g AS (SELECT v, n1, n0, p1, p0 FROM c WHERE n1 >= 0.05 * n0 AND n0 - n1 >= 0.05 * n0),
  s AS (SELECT v, (1 - pow(p0 / n0, 2) - pow(1 - p0 / n0, 2))
    - n1 / n0 * (1 - pow(p1 / n1, 2) - pow(1 - p1 / n1, 2))
    - (n0 - n1) / n0 * (1 - pow((p0 - p1) / (n0 - n1), 2) - pow(1 - (p0 - p1) / (n0 - n1), 2)) AS gain FROM g)
  SELECT v AS cut_after, round(gain, 9) AS gain FROM s ORDER BY gain DESC, v LIMIT 1""", ["fx_label"])
def tree_split(t):
    """The best first cut of a supervised band tree."""
    totals = binning.tree_totals(t.fx_label, "x1", "label", [0, 1])
    own = totals.agg(F.max("cum_k0"), F.max("cum_k1")).first()
    node = {"lo": None, "hi": None, "before": [0.0, 0.0], "own": list(own)}
    gain, v, _, _ = binning.tree_level(totals, [node], 2, sum(own) * 0.05)[0]
    return t.spark.createDataFrame([(v, gain)], "cut_after double, gain double").withColumn(
        "gain", F.round("gain", 9))


@query()
def bin_tree(t):
    """Rows-only: recursive; the tests compare it with a brute-force tree."""
    df = t.fx_label.withColumn("y", (F.col("x1") * (1 + F.col("x3") * 5) > 30).cast("int"))
    bands = binning.tree_bands(df, "x1", "y", [0, 1], max_leaf=5, min_percent=0.05)
    return binning.band_ranges(bands.apply(df, "x1"), "x1")


@query("""WITH s AS (SELECT CASE WHEN x1 = 50 THEN NULL WHEN x1 = 49 THEN -1 ELSE x1 END AS x FROM fx_label),
  q AS (SELECT quantile_cont(x, [0.25, 0.5, 0.75]) AS c, min(x) AS lo, max(x) AS hi FROM s
    WHERE x IS NOT NULL AND x <> -1),
  b AS (SELECT CASE WHEN x IS NULL OR x = -1 THEN -1 WHEN x <= c[1] THEN 0 WHEN x <= c[2] THEN 1
    WHEN x <= c[3] THEN 2 ELSE 3 END AS bin FROM s, q)
  SELECT bin, count(*) AS n, CASE bin WHEN -1 THEN '[-1, -1]'
    WHEN 0 THEN '[' || min(lo) || ', ' || min(c[1]) || ']'
    ELSE '(' || min(c[bin]) || ', ' || min(CASE WHEN bin = 3 THEN hi ELSE c[bin + 1] END) || ']' END AS bin_range
  FROM b, q GROUP BY bin, c""", ["fx_label"])
def bin_feature(t):
    x = F.when(F.col("x1") == 50, None).when(F.col("x1") == 49, -1.0).otherwise(F.col("x1"))
    _, bands = binning.bin_feature(t.fx_label.select(x.alias("x")), "x", "equal_freq", n=4)
    return bands


QUANT = {"score_01": 10, "score_02": 5, "score_03": 3, "score_04": 7, "score_10": 4}
QUANT_SQL = ", ".join(
    f"(SELECT list(DISTINCT c ORDER BY c) FROM (SELECT unnest(quantile_cont({s}, "
    f"[{', '.join(str(i / n) for i in range(n + 1))}])) AS c FROM fx_score)) AS c_{s}"
    for s, n in QUANT.items())
QUANT_AT = ", ".join(
    f"CAST(greatest(len(list_filter(c_{s}, lambda c: c < {s})) - 1, 0) AS INT) AS {s}_quant" for s in QUANT)


@query(f"""WITH q AS (SELECT {QUANT_SQL}) SELECT uid, {QUANT_AT} FROM fx_score, q""", ["fx_score"])
def quantile_cut(t):
    df = binning.quantile_cut(t.fx_score, QUANT)
    return df.select("uid", *[f"{s}_quant" for s in QUANT])


@query(f"""WITH q AS (SELECT {QUANT_SQL}), b AS (SELECT uid, {QUANT_AT} FROM fx_score, q)
  SELECT uid, CAST(100000 + score_01_quant * 10000 + score_02_quant * 1000 + score_03_quant * 100 + score_04_quant * 10
    + score_10_quant AS BIGINT) AS group_code
  FROM b""", ["fx_score"])
def group_code(t):
    return quantile_cut(t).select("uid", binning.group_code(
        [f"{s}_quant" for s in QUANT], list(QUANT.values())).alias("group_code"))


@query("""WITH b AS (SELECT CAST(bin AS VARCHAR) AS bin_index, sum(CASE WHEN label = 1 THEN w END) AS good,
    sum(CASE WHEN label = 0 THEN w END) AS bad FROM (SELECT label, w, CASE WHEN x1 <= 10 THEN 0
    WHEN x1 <= 20 THEN 1 WHEN x1 <= 40 THEN 2 END AS bin FROM fx_label) GROUP BY bin),
  s AS (SELECT *, coalesce(good, 0) + coalesce(bad, 0) AS total, good / sum(good) OVER () AS p,
    bad / sum(bad) OVER () AS q, sum(good) OVER () AS gg, sum(bad) OVER () AS bb FROM b),
  o AS (SELECT bin_index, good, bad, total, bad / total AS r, ln(p / q) AS woe, abs((p - q) * ln(p / q)) AS iv,
    bad / total / (bb / (gg + bb)) AS lift FROM s)
  SELECT bin_index, good, bad, total, round(r * 100, 1) AS bad_rate, round(woe, 6) AS woe, round(iv, 6) AS iv,
    round(lift, 2) AS lift FROM o UNION ALL
  SELECT 'total', sum(good), sum(bad), sum(total), round(sum(bad) / sum(total) * 100, 1), -9999, round(sum(iv), 6),
    -9999 FROM o""", ["fx_label"])
def woe_iv(t):
    rows = binning.fixed_bands([0, 10, 20, 40]).apply(t.fx_label, "x1")
    return rounded(binning.woe_iv(rows, "bin", "label", "w"), woe=6, iv=6)


WIDE = 34


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '1' || "
       + " || ".join(f"CAST((l_partkey + {i}) % 10 AS VARCHAR)" for i in range(34))
       + " AS group_code FROM fx_label", ["fx_label"])
def group_code_wide(t):
    """34 columns of 10 buckets: more digits than a long has."""
    df = t.fx_label.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                           *[((F.col("l_partkey") + i) % 10).alias(f"q{i}") for i in range(WIDE)])
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", binning.group_code(
        [f"q{i}" for i in range(WIDE)], [10] * WIDE).alias("group_code"))


@query("""WITH b AS (SELECT CASE WHEN x1 <= 10 THEN '(0, 10]' WHEN x1 <= 20 THEN '(10, 20]'
    WHEN x1 <= 40 THEN '(20, 40]' END AS bin_range, w FROM fx_label)
  SELECT bin_range, sum(w) AS total FROM b GROUP BY bin_range UNION ALL SELECT '(0, 40]', sum(w) FROM b""",
       ["fx_label"])
def woe_ranges(t):
    bands = binning.fixed_bands([0, 10, 20, 40])
    return binning.woe_iv(bands.apply(t.fx_label, "x1"), "bin", "label", "w",
                          ranges=binning.range_texts(bands)).select("bin_range", "total")


# --- correlations ------------------------------------------------------------------

PAIRS = list(combinations(X, 2))


def each_pair(text: str, source: str) -> str:
    """The expression for every pair of columns, as rows."""
    return " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round({text.format(a=a, b=b)}, 6) AS corr FROM {source}" for a, b in PAIRS)


def holed(t):
    """The four columns, one of them with nulls."""
    return t.fx_label.select("w", "x1", "x2", F.when(F.col("x1") > 5, F.col("x3")).alias("x3"), "x4")


HOLED = "s AS (SELECT w, x1, x2, CASE WHEN x1 > 5 THEN x3 END AS x3, x4 FROM fx_label)"


@query(f"WITH {HOLED} " + each_pair("coalesce(corr({a}, {b}), 0)", "s"), ["fx_label"])
def corr_pearson(t):
    return rounded(stats.corr_matrix(holed(t), X), corr=6)


def rank_sql(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"


RANKS = "r AS (SELECT w, " + ", ".join(f"{rank_sql(c)} AS {c}" for c in X) + " FROM fx_label)"


@query(f"WITH {RANKS} " + each_pair("corr({a}, {b})", "r"), ["fx_label"])
def corr_spearman(t):
    return rounded(stats.corr_matrix(t.fx_label, X, "spearman"), corr=6)


@query(f"WITH {HOLED} " + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr(p, q), 6) AS corr FROM (SELECT {rank_sql(a)} AS p, {rank_sql(b)} AS q FROM s"
    f" WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a, b in PAIRS), ["fx_label"])
def corr_spearman_nulls(t):
    return rounded(stats.corr_matrix(holed(t), X, "spearman"), corr=6)


@query(each_pair("(sum(w*{a}*{b})/sum(w) - sum(w*{a})/sum(w)*sum(w*{b})/sum(w)) / sqrt((sum(w*{a}*{a})/sum(w) - pow(sum(w*{a})/sum(w), 2))"
                 " * (sum(w*{b}*{b})/sum(w) - pow(sum(w*{b})/sum(w), 2)))", "fx_label"), ["fx_label"])
def corr_weighted_pearson(t):
    return rounded(stats.corr_matrix(t.fx_label, X, "pearson", "w"), corr=6)


@query(f"WITH {RANKS} " + each_pair("1 - 6 * sum(w * pow({a} - {b}, 2)) / (sum(w) * (sum(w) * sum(w) - 1))", "r"), ["fx_label"])
def corr_weighted_spearman(t):
    return rounded(stats.corr_matrix(t.fx_label, X, "spearman", "w"), corr=6)


def banded(t):
    """The prices in bands: SQL compares every distinct point of two columns with every other."""
    return t.fx_label.withColumn("x2", F.floor(F.col("x2") / 2000))


def kendall_sql(weight: str) -> str:
    def pair(a: str, b: str) -> str:
        return f"""SELECT '{a}' AS x, '{b}' AS y, round((p - q) / sqrt((p + q + t) * (p + q + u)), 6) AS corr FROM (
      SELECT sum(CASE WHEN (a.x - b.x) * (a.y - b.y) > 0 THEN a.w * b.w END) AS p,
        sum(CASE WHEN (a.x - b.x) * (a.y - b.y) < 0 THEN a.w * b.w END) AS q,
        sum(CASE WHEN a.x = b.x AND a.y <> b.y THEN a.w * b.w END) AS t,
        sum(CASE WHEN a.x <> b.x AND a.y = b.y THEN a.w * b.w END) AS u
      FROM c_{a}_{b} a JOIN c_{a}_{b} b ON (a.x, a.y) < (b.x, b.y))"""

    cells = ", ".join(f"c_{a}_{b} AS (SELECT {a} AS x, {b} AS y, sum({weight}::DOUBLE) AS w FROM l GROUP BY {a}, {b})" for a, b in PAIRS)
    return (f"WITH l AS (SELECT w, x1, floor(x2 / 2000) AS x2, x3, x4 FROM fx_label), {cells} "
            + " UNION ALL ".join(pair(a, b) for a, b in PAIRS))


@query(kendall_sql("1"), ["fx_label"])
def corr_kendall(t):
    return rounded(stats.corr_matrix(banded(t), X, "kendall"), corr=6)


@query(kendall_sql("w"), ["fx_label"])
def corr_weighted_kendall(t):
    return rounded(stats.corr_matrix(banded(t), X, "kendall", "w"), corr=6)


# --- feature tests -----------------------------------------------------------------

def f_tail_sql(tests: str, keys: str = "feature") -> str:
    """CTEs up to ``tails`` (keys, score, p_value): the tail of F by its continued fraction, one term per
    recursion, over the CTE ``tests`` (keys, score, d1, d2)."""
    turn = "1 / (1 + {n} * {d}) AS {d2}, 1 + {n} / {c} AS {c2}"
    even = "((m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2)))"
    odd = "(-(a + m + 1) * (a + b + m + 1) * x / ((a + 2 * m + 2) * (a + 2 * m + 3)))"
    return f"""tests AS ({tests}),
  ends AS (SELECT *, d2 / 2 AS a0, d1 / 2 AS b0, d2 / (d2 + d1 * score) AS x0, d1 * score / (d2 + d1 * score) AS y0 FROM tests),
  sides AS (SELECT *, x0 >= (a0 + 1) / (a0 + b0 + 2) AS swapped FROM ends),
  start AS (SELECT *, CASE WHEN swapped THEN b0 ELSE a0 END::DOUBLE AS a, CASE WHEN swapped THEN a0 ELSE b0 END::DOUBLE AS b,
    CASE WHEN swapped THEN y0 ELSE x0 END::DOUBLE AS x, CASE WHEN swapped THEN x0 ELSE y0 END::DOUBLE AS y FROM sides),
  lentz AS (SELECT {keys}, a, b, x, 0 AS m, 1.0::DOUBLE AS c, 1 / (1 - (a + b) * x / (a + 1)) AS d,
      1 / (1 - (a + b) * x / (a + 1)) AS h, 1.0::DOUBLE AS e FROM start
    UNION ALL
    SELECT {keys}, a, b, x, m + 1, c2, d2, h1 * c2 * d2, abs(c2 * d2 - 1) FROM (
      SELECT *, {turn.format(n=odd, d="d1", c="c1", d2="d2", c2="c2")} FROM (
        SELECT *, h * c1 * d1 AS h1 FROM (SELECT *, {turn.format(n=even, d="d", c="c", d2="d1", c2="c1")}
          FROM lentz WHERE e >= 1e-15::DOUBLE AND m < 400) q) q) q),
  sums AS (SELECT {keys}, arg_max(h, m) AS h FROM lentz GROUP BY {keys}),
  parts AS (SELECT {keys}, score, swapped, x, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(y)) * h / a AS part
    FROM start JOIN sums USING ({keys})),
  tails AS (SELECT {keys}, score, CASE WHEN score <= 0 THEN 1 WHEN swapped THEN 1 - part ELSE part END AS p_value FROM parts)"""


CHI2_TAIL = """ends AS (SELECT feature, score, dof / 2 AS a, score / 2 AS x FROM tests),
  series AS (SELECT feature, a, x, 0 AS n, 1 / a AS t, 1 / a AS h FROM ends WHERE x < a + 1
    UNION ALL SELECT feature, a, x, n + 1, t * x / (a + n + 1), h + t * x / (a + n + 1) FROM series WHERE t > h * 1e-15 AND n < 400),
  lentz AS (SELECT feature, a, x, 0 AS m, 1e300::DOUBLE AS c, 1 / (x + 1 - a) AS d, 1 / (x + 1 - a) AS h, 1.0::DOUBLE AS e
      FROM ends WHERE x >= a + 1
    UNION ALL SELECT feature, a, x, m + 1, c1, d1, h * c1 * d1, abs(c1 * d1 - 1) FROM (
      SELECT *, 1 / (x + 3 - a + 2 * m - (m + 1) * (m + 1 - a) * d) AS d1, x + 3 - a + 2 * m - (m + 1) * (m + 1 - a) / c AS c1
      FROM lentz WHERE e >= 1e-15::DOUBLE AND m < 400) q),
  tails AS (SELECT feature, score, CASE WHEN x < a + 1 THEN 1 - exp(a * ln(x) - x - lgamma(a)) * (SELECT max(h) FROM series s WHERE
      s.feature = ends.feature) ELSE exp(a * ln(x) - x - lgamma(a)) * (SELECT arg_max(h, m) FROM lentz l WHERE l.feature = ends.feature)
    END AS p_value FROM ends)"""

FLAGGED = """SELECT feature, round(score, {d}) AS score, round(p_value, 6) AS p_value,
  CAST(row_number() OVER (ORDER BY score DESC, feature) <= 1 AS INT) AS is_selected_score,
  CAST(p_value <= 0.05 AS INT) AS is_selected_p FROM tails"""


def anova_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, (sum(n * pow(m - g, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS score,
      CAST(count(*) - 1 AS DOUBLE) AS d1, CAST(sum(n) - count(*) AS DOUBLE) AS d2 FROM (SELECT count({c}) AS n, avg({c}) AS m,
      var_pop({c}) AS v, (SELECT avg({c}) FROM fx_label) AS g FROM fx_label GROUP BY label)"""


@query(f"WITH RECURSIVE {f_tail_sql(' UNION ALL '.join(anova_sql(c) for c in X))} " + FLAGGED.format(d=6), ["fx_label"])
def anova_f(t):
    return rounded(stats.anova_f(t.fx_label, X, "label"), score=6, p_value=6)


def regression_sql(c: str) -> str:
    return (f"SELECT '{c}' AS feature, pow(corr({c}, x2), 2) / (1 - pow(corr({c}, x2), 2)) * (count(*) - 2) AS score,"
            " 1::DOUBLE AS d1, CAST(count(*) - 2 AS DOUBLE) AS d2 FROM fx_label")


@query(f"WITH RECURSIVE {f_tail_sql(' UNION ALL '.join(regression_sql(c) for c in ['x1', 'x3', 'x4']))} " + FLAGGED.format(d=4),
       ["fx_label"])
def f_regression(t):
    return rounded(stats.f_regression(t.fx_label, ["x1", "x3", "x4"], "x2"), score=4, p_value=6)


CHI2 = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, sum(pow(o - e, 2) / e) AS score, CAST(count(*) - 1 AS DOUBLE) AS dof FROM (SELECT sum({c}) AS o,"
    f" count(*) / (SELECT count(*) FROM fx_label) * (SELECT sum({c}) FROM fx_label) AS e FROM fx_label GROUP BY label)" for c in X)


@query(f"WITH RECURSIVE tests AS ({CHI2}), {CHI2_TAIL} " + FLAGGED.format(d=6), ["fx_label"])
def chi2(t):
    return rounded(stats.chi2(t.fx_label, X, "label"), score=6, p_value=6)


def conditional_sql(c: str, rows: str = "fx_label") -> str:
    return f"""SELECT '{c}' AS feature, e * (n - k - 1) / (syy - e) AS score, 1::DOUBLE AS d1, CAST(n - k - 1 AS DOUBLE) AS d2 FROM (SELECT
      pow(sum(n * cxy), 2) / sum(n * vx) AS e, sum(n * vy) AS syy, sum(n) AS n, count(*) AS k FROM (SELECT
      count(*) AS n, covar_pop({c}, label) AS cxy, var_pop({c}) AS vx, var_pop(label) AS vy FROM {rows}
      GROUP BY item))"""


@query(f"WITH RECURSIVE {f_tail_sql(' UNION ALL '.join(conditional_sql(c) for c in X))} "
       "SELECT feature, round(score, 6) AS score, round(p_value, 6) AS p_value FROM tails", ["fx_label"])
def conditional_f(t):
    return rounded(stats.conditional_f(t.fx_label, X, "label", "item"), score=6, p_value=6)


EFFECTS = [*SCORES, "ite"]
ARM_FITS = "s AS (SELECT e.*, " + ", ".join(SCORES) + " FROM fx_experiment e JOIN fx_score USING (uid)), " + ", ".join(
    f"""m_{c} AS (SELECT treatment, count(*) AS n, covar_pop({c}, y) / var_pop({c}) AS b,
      count(*) * var_pop({c}) AS sxx, count(*) * (var_pop(y) - pow(covar_pop({c}, y), 2) / var_pop({c})) AS rss
      FROM s GROUP BY treatment)""" for c in EFFECTS)


def uplift_sql(c: str) -> str:
    return f"""SELECT a.treatment AS arm, '{c}' AS feature, a.n AS n_arm, pow(a.b - z.b, 2) * (a.n + z.n - 4)
      / ((a.rss + z.rss) * (1 / a.sxx + 1 / z.sxx)) AS score, 1::DOUBLE AS d1, CAST(a.n + z.n - 4 AS DOUBLE) AS d2
      FROM m_{c} a JOIN m_{c} z ON z.treatment = 'control' AND a.treatment <> 'control'"""


UPLIFT = " UNION ALL ".join(uplift_sql(c) for c in EFFECTS)


@query(f"WITH {ARM_FITS}, u AS ({UPLIFT}) SELECT arm, feature, round(score, 5) AS score FROM u", ["fx_experiment", "fx_score"])
def uplift_f_scores(t):
    df = t.fx_experiment.join(t.fx_score, "uid")
    out = stats.uplift_scores(df, EFFECTS, "treatment", "control", "y")
    return rounded(out.select("arm", "feature", "score"), score=5)


@query(f"""WITH RECURSIVE {ARM_FITS}, {f_tail_sql(UPLIFT, "arm, feature")},
  means AS (SELECT feature, sum(p_value * n_arm) / sum(n_arm) AS p FROM tails JOIN tests USING (arm, feature) GROUP BY feature)
  SELECT feature, round(p, 6) AS p_value_mean, CAST(p <= 0.05 AS INT) AS keep FROM means""", ["fx_experiment", "fx_score"])
def uplift_f(t):
    """Mean p-value over the arms of all five scores and the effect."""
    df = t.fx_experiment.join(t.fx_score, "uid")
    return rounded(stats.uplift_f(df, EFFECTS, "treatment", "control", "y"), p_value_mean=6)
