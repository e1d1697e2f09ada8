"""Input shapes of the offer flow, as SQL over the driver tables (see FIXTURES.md).

The same text runs on Spark and DuckDB; ``{table}`` marks an input table.
"""

from __future__ import annotations

import re


def tables_of(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def _share(p_type: str, name: str) -> str:
    return (f"round(coalesce(sum(CASE WHEN p_type = '{p_type}' THEN l_extendedprice END)"
            f" / sum(l_extendedprice), 0), 6) AS {name}")


def _rule(test: str, name: str) -> str:
    return (f"CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 0"
            f" ELSE CAST({test} AS INT) END AS {name}")


VIEWS = {
    "fx_score": (
        "SELECT o_custkey AS uid, CAST(o_custkey % 10 AS INT) AS group_index, "
        + ", ".join([_share("ECONOMY", "score_01"), _share("SMALL", "score_02"),
                     _share("MEDIUM", "score_03"), _share("PROMO", "score_04"),
                     _share("STANDARD", "score_10")])
        + " FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey"
          " JOIN {part} ON p_partkey = l_partkey GROUP BY o_custkey"),
    "fx_rule": (
        "SELECT c_custkey AS uid, "
        + ", ".join([_rule("c_custkey % 3 <> 0", "rule_01"), _rule("c_acctbal > 0", "rule_02"),
                     _rule("c_mktsegment <> 'BUILDING'", "rule_03"),
                     _rule("c_nationkey < 20", "rule_04")])
        + " FROM {customer}"),
    "fx_positive": (
        "SELECT user_id AS uid, CAST(date_trunc('week', ts) AS DATE) AS obs_dt,"
        " CAST(ts AS DATE) AS dt, event_type AS item, event_id FROM {events}"),
    "fx_label": (
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x1,"
        " l_extendedprice AS x2, l_discount AS x3, l_tax AS x4, l_linestatus AS item,"
        " CAST(l_returnflag = 'R' AS INT) AS label, l_quantity AS w,"
        " 1 / (1 + l_extendedprice / CAST(50000 AS DOUBLE)) AS score FROM {lineitem}"),
    "fx_experiment": (
        "SELECT c_custkey AS uid,"
        " CASE c_mktsegment WHEN 'BUILDING' THEN 'control' WHEN 'AUTOMOBILE' THEN 'treatment_1'"
        " WHEN 'FURNITURE' THEN 'treatment_2' WHEN 'HOUSEHOLD' THEN 'treatment_3'"
        " ELSE 'treatment_4' END AS treatment,"
        " CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 0.0 WHEN 'AUTOMOBILE' THEN 0.2"
        " WHEN 'FURNITURE' THEN 0.5 WHEN 'HOUSEHOLD' THEN 1.0 ELSE 1.5 END AS DOUBLE) AS cost,"
        " CAST(coalesce(o.n, 0) >= 10 AS INT) AS y, c_acctbal / 10000 AS ite"
        " FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders}"
        " GROUP BY o_custkey) o ON o_custkey = c_custkey"),
    "fx_choice": (
        "SELECT o_custkey AS class_id, CAST(k AS INT) AS choice,"
        " round(ln(1 + count(*)) * sqrt(CAST(a AS DOUBLE)), 6) AS value,"
        " CAST(a AS DOUBLE) AS weight FROM {orders} CROSS JOIN (VALUES (0, 0.2), (1, 0.5),"
        " (2, 1.0), (3, 1.5), (4, 1.8)) t(k, a) GROUP BY o_custkey, k, a"),
    "fx_embed_item": (
        "SELECT e.vec_id AS item_id, e.label, e.embedding FROM {embeddings} e JOIN"
        " (SELECT label AS lb, min(vec_id) AS v FROM {embeddings} GROUP BY label) m"
        " ON e.vec_id = m.v"),
    "fx_embed_user": (
        "SELECT e.vec_id AS uid, e.label, e.embedding FROM {embeddings} e LEFT JOIN"
        " (SELECT min(vec_id) AS v FROM {embeddings} GROUP BY label) m"
        " ON e.vec_id = m.v WHERE m.v IS NULL"),
}

# On Spark the amounts are exploded inside the row instead of joined.
SPARK_VIEWS = {
    "fx_choice": (
        "SELECT class_id, c.k AS choice, round(ln(1 + n) * sqrt(c.a), 6) AS value,"
        " c.a AS weight FROM (SELECT class_id, n, explode(array("
        "named_struct('k', 0, 'a', 0.2D), named_struct('k', 1, 'a', 0.5D),"
        " named_struct('k', 2, 'a', 1.0D), named_struct('k', 3, 'a', 1.5D),"
        " named_struct('k', 4, 'a', 1.8D))) AS c FROM (SELECT o_custkey AS class_id,"
        " count(*) AS n FROM {orders} GROUP BY o_custkey))"),
}

SCORES = ["score_01", "score_02", "score_03", "score_04", "score_10"]
ITEMS = ["cashback", "voucher", "points", "trial", "upgrade"]
CODES = [11, 12, 13, 14, 90]
RATIOS = [0.0, 0.25, 0.45, 0.3, 0.0]
