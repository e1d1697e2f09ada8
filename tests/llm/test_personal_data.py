"""Personal data against patterns and checksums written apart from the operator."""

import hashlib
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from check_queries import rows_of
from offerflow.llm import personal_data, queries

SF = "/root/testdata/sf0.001"


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def account(m):
    """Length of a confirmed account number at the start of the match, or None."""
    n = personal_data.IBAN_LENGTHS.get(m[:2])
    if n is None:
        return None
    width = n + (n - 1) // 4 if m[4] == " " else n
    body = m[:width].replace(" ", "")
    if len(m) < width:
        return None
    return width if int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1 else None


NUMBER = r"[+(]?[0-9]+(?:\)?[ .-]?\(?[0-9]+)*"
CALL = "phone|tel|telephone|call|mobile|cell|fax"
WANT = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", len, 80, "e-?mail|mail|contact|write", True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: len(m) if all(int(p) <= 255 for p in m.split(".")) else None,
     50, "ip|address|host|server|login|client", True),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: len(m) if 13 <= len(digits(m)) <= 19 and luhn(digits(m)) else None, 70,
     "card|visa|mastercard|amex|credit|debit|payment", True),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: len(m) if 9 <= len(digits(m)) <= 15 else None, 60, CALL, True),
    ("iban", r"[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})", account, 85,
     "iban|account|konto|compte|cuenta|bank", False),
    ("ssn", NUMBER, lambda m: len(m) if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", m) else None, 25,
     "ssn|social security(?: number| no)?", False),
    ("local_phone", NUMBER, lambda m: len(m) if re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", m) else None, 25,
     CALL, False),
]


def brute(text):
    """(kind, start, end, score) by kind and start."""
    text, out = text or "", []
    for kind, pattern, width, score, up, base in WANT:
        found = list(re.finditer(pattern, text, re.A))
        for k, m in enumerate(found):
            n = width(m[0])
            if n is None:
                continue
            gap = text[found[k - 1].end() if k else 0:m.start()]
            after = text[m.end():found[k + 1].start() if k + 1 < len(found) else len(text)]
            near = gap[-40:] + " | " + after[:20]
            if not base and (re.search("[A-Za-z0-9]$", gap) or (k and not gap)):
                continue
            now = score
            for words, by in ((up, 35), ("version|release|isbn|order|invoice|figure", -35)):
                if re.search(f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)", near, re.I | re.A):
                    now += by
            now = max(0, min(100, now))
            if base or now >= 50:
                out.append((kind, m.start(), m.start() + n, now))
    return out


def digest(doc_id, text):
    spans = brute(text)
    told = [f"{k}:{a}:{b}" for k, a, b, _ in spans]
    base = [t for t in told if t.split(":")[0] in ("email", "ip", "card", "phone")]
    n = [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
    return (doc_id, *n, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(told), [s[3] for s in spans])


def digests(spark, docs, tmp_path):
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return queries.op13_personal_data(spark, str(tmp_path))


PIECES = ["a.b@c.de", "x@y", "x@@y.com", "a@b.com_z@d.org", "-@-.-", "a@b.c@d.e", "10.0.0.255", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.002.003.004",
          "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "0000000000000", "4 1-1 1", "+1 (743) 555-3824",
          "+49 30 1234567.", "+1234", "++12345678901", "+1..........2", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82WEST12345698765432",
          "DE89 3704 0044 0532 0130 01", "XX89 3704 0044 0532", "xDE89370400440532013000", "123-45-6789", "SSN: 123-45-6789", "(555) 123-4567",
          "call 555-123-4567", "tel", "phone", "order", "version", "card", "é", "ÀÖ", "日本", "😀", "\n", " ", " ", ".", "-", "+", "(", ")", "IBAN", "7", "word"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    out = [None, "", " ", *PIECES]
    for _ in range(400):
        out.append(rng.choice(["", " "]).join(rng.choices(PIECES, k=rng.randint(1, 25))))
    for _ in range(400):
        out.append("".join(rng.choices("0123456789 .-+()@aZ%_é", k=rng.randint(1, 60))))
    out += ["mail a@b.de " * 3000, " ".join(f"+1 555 {i:07d}" for i in range(2000)), "1.2.3.4," * 700]
    return out


def test_odd_texts(spark, texts, tmp_path):
    """Against brute force: nulls, empty and long texts, many matches, repeated rows, clashing names."""
    rows = [(i, t, "p", 1, "s") for i, t in enumerate(texts)] + [(5, texts[5], "p", 1, "s")] * 2 + [(None, "a@b.cd", "p", 1, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, email string, base int, spans string").repartition(8)
    got = digests(spark, docs, tmp_path).collect()
    key = str
    for a, b in zip(sorted(map(tuple, got), key=key), sorted((digest(r[0], r[1]) for r in rows), key=key)):
        assert a == b


def test_query_and_its_twin(spark, small, odd_docs, tmp_path):
    for name, docs in (("small", small), ("odd", odd_docs)):
        got = digests(spark, docs, tmp_path / name)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(digest(r["doc_id"], r["text"])) for r in docs.collect())
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/{name}/documents.parquet/*.parquet')")
        cur = con.execute(queries.ORACLES["op13_personal_data"])
        assert rows_of(got.columns, got.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_long_texts_end(spark):
    """A megabyte without white space costs no more than any other, and ends no stack."""
    units = ["1", "a", "a.", "1.", "+1", "1 ", "(", "((1", "a@", "-", "AB12", "+1(", "1-", "a@b."]
    docs = spark.createDataFrame([(i, u * (1_000_000 // len(u))) for i, u in enumerate(units)], "doc_id long, text string")
    start = time.time()
    assert personal_data.personal_spans(docs.repartition(len(units), "doc_id")).count() == len(units)
    personal_data.personal_spans(docs.repartition(len(units), "doc_id")).write.format("noop").mode("overwrite").save()
    assert time.time() - start < 90


def test_empty_table_and_plan(spark, odd_docs):
    found = personal_data.personal_spans(odd_docs.limit(0))
    assert found.collect() == []
    plan = personal_data.personal_spans(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_checksums(spark):
    numbers = ["4111111111111111", "4111111111111112", "0", "18", "79927398713"]
    got = spark.createDataFrame([(n,) for n in numbers], "n string").select(personal_data.luhn(F.col("n"))).collect()
    assert [r[0] for r in got] == [luhn(n) for n in numbers] == [True, False, True, True, True]
    accounts = ["DE89370400440532013000", "DE89370400440532013001", "GB82WEST12345698765432"]
    got = spark.createDataFrame([(n,) for n in accounts], "n string").select(personal_data.mod_97(F.col("n"))).collect()
    assert [r[0] for r in got] == [True, False, True]
