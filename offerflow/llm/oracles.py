"""SQL twins (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from offerflow.llm.personal_data import AFTER, BEFORE, IBAN_LENGTHS, MIN_SCORE, WORD_SCORE

# --- op11: levels by recursion, then the path of every row --------------------------------------

_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: xor(list_reduce(list_prepend(xor(a, b) & 255, [CAST(0 AS BIGINT) for _ in range(8)]),
    lambda x, _: xor(x >> 1, (x & 1) * 3988292384)), a >> 8)), 4294967295)"""


def _leaf(more: str) -> str:
    fields = ["doc_id", "source", "lang", f"n_chars + {more}", "text"]
    return "sha256(" + " || ".join(
        f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"


OP11 = f"""
WITH RECURSIVE
rows AS (
  SELECT row_number() OVER () AS rid, doc_id, lang IS NOT NULL AS named, coalesce(lang, '') AS lang, {_leaf("0")} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND doc_id IS NOT NULL AND ({_CRC}) % 7 = 0 THEN {_leaf("1")} END AS other
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY named, lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS idx,
    count(*) OVER (PARTITION BY named, lang) AS n FROM rows),
tree(named, lang, level, idx, digest, n) AS (
  SELECT named, lang, 0, idx, leaf, n FROM placed
  UNION ALL
  SELECT named, lang, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (n + 1) // 2
  FROM tree WHERE n > 1 GROUP BY named, lang, level, idx // 2, n),
subroots AS (
  SELECT named, lang, level AS depth, digest, row_number() OVER (ORDER BY named, encode(lang)) - 1 AS pos, count(*) OVER () AS n
  FROM tree WHERE n = 1),
top(level, idx, digest, n) AS (
  SELECT 0, pos, digest, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (n + 1) // 2
  FROM top WHERE n > 1 GROUP BY level, idx // 2, n),
fold(rid, named, lang, level, idx, now, proof) AS (
  SELECT rid, named, lang, 0, idx, coalesce(other, leaf), '' FROM placed
  UNION ALL
  SELECT f.rid, f.named, f.lang, f.level + 1, f.idx // 2,
    sha256(CASE WHEN s.digest IS NULL THEN f.now WHEN f.idx % 2 = 0 THEN f.now || s.digest ELSE s.digest || f.now END),
    f.proof || coalesce(s.digest, '')
  FROM fold f JOIN subroots r ON r.named = f.named AND r.lang = f.lang AND f.level < r.depth
  LEFT JOIN tree s ON s.named = f.named AND s.lang = f.lang AND s.level = f.level AND s.idx = xor(f.idx, 1)),
climb(rid, level, idx, now, proof) AS (
  SELECT f.rid, 0, r.pos, f.now, f.proof FROM fold f
  JOIN subroots r ON r.named = f.named AND r.lang = f.lang AND f.level = r.depth
  UNION ALL
  SELECT c.rid, c.level + 1, c.idx // 2,
    sha256(CASE WHEN s.digest IS NULL THEN c.now WHEN c.idx % 2 = 0 THEN c.now || s.digest ELSE s.digest || c.now END),
    c.proof || coalesce(s.digest, '')
  FROM climb c JOIN (SELECT max(level) AS depth FROM top) d ON c.level < d.depth
  LEFT JOIN top s ON s.level = c.level AND s.idx = xor(c.idx, 1))
SELECT p.doc_id, p.leaf, r.digest AS subroot, t.digest AS root, sha256(c.proof) AS proof_sha256, c.now AS folded_root,
  c.now = t.digest AS verified
FROM placed p JOIN subroots r ON r.named = p.named AND r.lang = p.lang
JOIN (SELECT digest, level FROM top WHERE n = 1) t ON true
JOIN climb c ON c.rid = p.rid AND c.level = t.level
"""

# --- op12: rounds unrolled ------------------------------------------------------------------------


def _rounds(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    parts = [f"""
kept AS (SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE len(embedding) = {size}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < 524288)) = {size}),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS BIGINT) AS c, v FROM (
  SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k}))"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS (SELECT rid, m % 1024 AS c, m // 1024 AS d FROM (
  SELECT rid, min(CAST(list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, y.v) + list_dot_product(y.v, y.v) AS BIGINT)
    * 1024 + y.c) AS m FROM kept x, c{i} y GROUP BY rid))""")
        if i < rounds:
            parts.append(f"""
m{i} AS (SELECT c, list(CAST(floor_of AS DOUBLE) ORDER BY j) AS v FROM (
    SELECT c, j, (s - (((s % n) + n) % n)) // n AS floor_of FROM (
      SELECT a.c, j, sum(CAST(x.v[j] AS BIGINT)) AS s, count(*) AS n
      FROM a{i} a JOIN kept x ON x.rid = a.rid, (SELECT unnest(range(1, {size + 1})) AS j) GROUP BY a.c, j)) GROUP BY c),
c{i + 1} AS (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)""")
    return f"""WITH {",".join(parts)}
SELECT kept.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(z.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM kept JOIN a{rounds} a ON a.rid = kept.rid JOIN c{rounds} z ON z.c = a.c
"""


OP12 = _rounds()

# --- op13: texts cut at the matches, places by running sums ----------------------------------------

_PART = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DIGITS = "regexp_replace(m, '[^0-9]+', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(length({_DIGITS})), lambda i:
  CASE WHEN i % 2 = 0 THEN CAST({_DIGITS}[length({_DIGITS}) - i] AS INTEGER)
    WHEN CAST({_DIGITS}[length({_DIGITS}) - i] AS INTEGER) > 4 THEN 2 * CAST({_DIGITS}[length({_DIGITS}) - i] AS INTEGER) - 9
    ELSE 2 * CAST({_DIGITS}[length({_DIGITS}) - i] AS INTEGER) END)) % 10 = 0"""
_COUNTRIES = ", ".join(f"'{c}': {n}" for c, n in IBAN_LENGTHS.items())
_COUNTRY = f"coalesce(map {{{_COUNTRIES}}}[m[1:2]], 0)"
_WIDTH = f"({_COUNTRY} + CASE WHEN m[5] = ' ' THEN ({_COUNTRY} - 1) // 4 ELSE 0 END)"
_ACCOUNT = f"replace(m[1:{_WIDTH}], ' ', '')"
_MOD = f"""list_reduce(list_prepend(0, list_transform(string_split({_ACCOUNT}[5:] || {_ACCOUNT}[1:4], ''),
  lambda c: CASE WHEN ascii(c) <= 57 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
  lambda a, c: CASE WHEN c < 10 THEN (a * 10 + c) % 97 ELSE (a * 100 + c) % 97 END) = 1"""
_NUMBER = r"[+(]?[0-9]+(?:\)?[\x20.-]?\(?[0-9]+)*"
_DOWN = "version|release|isbn|order|invoice|figure"
_CALL = "phone|tel|telephone|call|mobile|cell|fax"
# kind, pattern, condition on the match m, score, words that speak for it, base, width
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 80, "e-?mail|mail|contact|write", True, "length(m)"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", rf"regexp_full_match(m, '{_PART}(\.{_PART}){{3}}')", 50,
     "ip|address|host|server|login|client", True, "length(m)"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"CASE WHEN length({_DIGITS}) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END", 70,
     "card|visa|mastercard|amex|credit|debit|payment", True, "length(m)"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15", 60, _CALL, True, "length(m)"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})",
     f"CASE WHEN {_WIDTH} > 0 AND length(m) >= {_WIDTH} THEN {_MOD} ELSE false END", 85, "iban|account|konto|compte|cuenta|bank",
     False, _WIDTH),
    ("ssn", _NUMBER, "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')", 25, "ssn|social security(?: number| no)?", False, "length(m)"),
    ("local_phone", _NUMBER, r"regexp_full_match(m, '\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}')", 25, _CALL, False, "length(m)"),
)


def _near(words: str) -> str:
    return (f"CASE WHEN regexp_matches(right(g, {BEFORE}) || ' | ' || left(nx, {AFTER}), "
            f"'(?i)(?:^|[^a-z])(?:{words})(?:[^a-z]|$)') THEN {WORD_SCORE} ELSE 0 END")


def _kind(rank: int, name: str, pattern: str, ok: str, score: int, up: str, base: bool, width: str) -> str:
    kept = "" if base else rf" AND NOT regexp_matches(g, '[A-Za-z0-9]$') AND (k = 1 OR g <> '') AND score >= {MIN_SCORE}"
    return rf"""
SELECT rid, {rank} AS rank, '{name}' AS kind, start, start + {width} AS stop, score, {str(base).lower()} AS base FROM (
  SELECT rid, k, m, g, sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY k) - length(m) AS start,
    greatest(0, least(100, {score} + {_near(up)} - {_near(_DOWN)})) AS score
  FROM (SELECT rid, k, found[k] AS m, gaps[k] AS g, gaps[k + 1] AS nx FROM (
    SELECT rid, found, gaps, unnest(range(1, len(found) + 1)) AS k FROM (
      SELECT rid, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS gaps FROM docs))))
WHERE ({ok}){kept}"""


OP13 = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_kind(i, *k) for i, k in enumerate(_KINDS))}),
told AS (SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
    count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) FILTER (base) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) AS spans,
    list(CAST(score AS INTEGER) ORDER BY rank, start) AS scores
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
  coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(scores, CAST([] AS INTEGER[])) AS scores
FROM docs LEFT JOIN told ON told.rid = docs.rid
"""

ORACLES = {"op11_merkle_manifest": OP11, "op12_pivot_clusters": OP12, "op13_personal_data": OP13}
