"""Secret scans with linking of multipart credentials.

Base findings are single patterns. Beyond them, weak parts of a credential - access
identifiers, opaque strings, endpoints - are found on their own and joined by interval: a weak
part is reported only where a complementary part lies in its scope, the text within a given
number of characters around it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerflow.llm.common import KEY, row_key, text_of
from offerflow.session import stage

#: Characters between two parts of one credential, at most.
SCOPE = 300

# The base patterns, in the order of their kinds.
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "link_id", "link_secret", "link_endpoint")

# Weak parts, by what they may be: an identifier, a secret, an endpoint.
_LINK_ID = re.compile(
    r"(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)[\"']?[ ]*[:=][ ]*[\"']?"
    r"([A-Za-z0-9@+/_.-]{3,})", re.I | re.A)
# a whole token of 24 characters or more with a digit and a capital, both inside the token
_LINK_SECRET = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{24,}+={0,2}+(?![A-Za-z0-9+/_=-])")
_LINK_ENDPOINT = re.compile(
    r"(?:(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}"
    r"|(?:host|endpoint|server|url)[\"']?[ ]*[:=][ ]*[\"']?[A-Za-z0-9.:/_-]{4,})", re.I | re.A)
#: Which parts make a weak part of each kind worth reporting.
PARTNERS = {"link_id": ("assign", "hex", "link_secret"),
            "link_secret": ("access", "link_id", "link_endpoint"),
            "link_endpoint": ("assign", "access", "hex", "link_secret")}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: leftmost non-overlapping matches of each base
    pattern, those too short left out."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def weak_parts(text: str) -> list[tuple[str, int, int]]:
    """Candidates for parts of a credential, without regard to what stands near them."""
    out = [("link_id", m.start(1), m.end(1)) for m in _LINK_ID.finditer(text)]
    out += [("link_secret", m.start(), m.end()) for m in _LINK_SECRET.finditer(text)]
    return out + [("link_endpoint", m.start(), m.end()) for m in _LINK_ENDPOINT.finditer(text)]


def secret_spans(docs: DataFrame, scope: int = SCOPE, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per document: the row key, doc_id, base and spans, both arrays of
    (start, rank of kind, kind, end) in order, in code points of the text; ``spans`` adds the weak
    parts that have a complementary part within ``scope`` characters to the base findings.

    Null text is empty; repeated rows are scanned each; an empty table gives no rows. Texts are
    scanned where they lie. Only parts move, joined on document and stretch of ``scope``
    characters, so a text with very many parts is many keys."""
    rows = docs.select(*row_key(docs, doc_id), F.col(f"`{doc_id}`").alias("doc_id"),
                       text_of(f"`{text}`").alias("text"))
    span = "struct<start:long,rank:int,kind:string,end:long>"
    id_type = docs.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()),
                                   ("kind", pa.string()), ("end", pa.int64())]))
        number = TaskContext.get().partitionId() << 33

        def ordered(spans):
            rank = KINDS.index
            return [{"start": a, "rank": rank(k), "kind": k, "end": b}
                    for k, a, b in sorted(spans, key=lambda s: (s[1], rank(s[0]), s[2]))]

        for batch in batches:
            texts = batch.column(3).to_pylist()
            base, weak = [base_spans(t) for t in texts], [weak_parts(t) for t in texts]
            ids = pa.array(range(number, number + len(texts)), pa.int64())
            number += len(texts)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(3)], ids, pa.array(map(ordered, base), kind),
                 pa.array(map(ordered, weak), kind)],
                names=[*KEY, "doc_id", "row", "base", "weak"])

    found = stage(rows.mapInArrow(
        scan, f"{KEY[0]} string, {KEY[1]} long, doc_id {id_type}, row long, base array<{span}>, weak array<{span}>"),
        "secret-parts")
    weak = found.filter(F.size("weak") > 0)
    parts = weak.select("row", F.explode(F.concat("base", "weak")).alias("s")).select(
        "row", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"))
    # each part waits in every stretch it touches, each candidate asks in those its scope touches
    waiting = parts.withColumn("bin", F.explode(F.sequence(
        F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)))).withColumnsRenamed(
        {"start": "p_start", "end": "p_end", "kind": "p_kind"})
    asking = (weak.select("row", F.explode("weak").alias("s"))
              .select("row", "s", F.explode(F.sequence(
                  F.floor(F.greatest(F.col("s.start") - scope, F.lit(0)) / scope),
                  F.floor((F.col("s.end") + scope) / scope))).alias("bin")))
    fits = F.lit(False)
    for k, partners in PARTNERS.items():
        fits = fits | ((F.col("s.kind") == k) & F.col("p_kind").isin(*partners))
    near = (F.col("p_start") <= F.col("s.end") + scope) & (F.col("p_end") >= F.col("s.start") - scope)
    apart = (F.col("p_end") <= F.col("s.start")) | (F.col("p_start") >= F.col("s.end"))
    linked = (asking.alias("x").join(waiting.alias("y"), (F.col("x.row") == F.col("y.row"))
                                     & (F.col("x.bin") == F.col("y.bin")) & near & apart & fits, "left_semi")
              .groupBy("row").agg(F.collect_set("s").alias("_linked")))
    return found.join(linked, "row", "left").select(
        *KEY, "doc_id", "base",
        F.sort_array(F.concat("base", F.coalesce("_linked", F.array().cast(f"array<{span}>")))).alias("spans"))


def span_text(spans: str):
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, mark: str = "[secret]", doc_id: str = "doc_id", text: str = "text",
             scope: int = SCOPE) -> DataFrame:
    """(row key, doc_id, text) of the documents with findings, every span replaced by ``mark``."""
    found = secret_spans(docs, scope, doc_id, text).filter(F.size("spans") > 0).dropDuplicates([*KEY])
    keyed = docs.select(*row_key(docs, doc_id), F.col(f"`{text}`").alias("text"))
    joined = found.join(keyed, [*KEY]).select(*KEY, "doc_id", "spans", "text")
    cut = F.aggregate(
        "spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(F.struct(
            F.concat(a["out"], F.when(s["start"] >= a["at"], F.concat(
                F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark)))
                .otherwise(F.lit(""))).alias("out"), s["end"].alias("at"))),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.lit(2 ** 31 - 1))))
    return joined.select(*KEY, "doc_id", cut.alias("text"))
