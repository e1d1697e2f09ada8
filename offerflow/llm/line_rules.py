"""Quality rules: base rules on a document's own words, and line frequency across documents.

Lines are normalised and hashed with their host; a line found in more documents of the host
than the limit is taken out of all of them. A document that loses most of its words that way is
rejected. SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerflow.llm.common import GAP, KEY, WORD, group_key, row_key, text_of, word_list
from offerflow.session import stage

#: A line stays while at most this many documents of its host have it, however many the host has.
MAX_DOCS = 20
#: A document with less of its words left is depleted.
MIN_LEFT = 0.3


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more, each word once.

    Windows are hashed; only a text with equal hashes sorts them. A window at p covers p to
    p + 2, so over the sorted starts each adds at most three words."""
    windows = F.when(F.size(words) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            twice = F.filter(p, lambda s, k: (F.get(p, k - 1)["h"] == s["h"])
                             | F.coalesce(F.get(p, k + 1)["h"] == s["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda s: s["i"]))

        at = F.get(F.transform(F.array(placed), starts), F.lit(0))
        return F.aggregate(
            at, F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
            lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(3), x - a["at"])).alias("n")),
            lambda a: a["n"])

    def unless_distinct(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(counted(h))

    value = F.get(F.transform(F.array(windows), unless_distinct), F.lit(0))
    return F.when(F.size(words) >= 3, value).otherwise(F.lit(0)).cast("long")


def document_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      host: str = "source") -> DataFrame:
    """Per document the counts of the base rules, its row key, and the hash and word count of
    each line with a word. Nothing is shuffled and the text is read once."""
    rows = docs.select(*row_key(docs, doc_id), F.col(f"`{doc_id}`").alias("doc_id"),
                       text_of(f"`{text}`").alias("_text"), group_key(f"`{host}`").alias("_host"))
    parts = rows.select(
        *KEY, "doc_id", "_text", F.xxhash64("_host").alias("_host"),
        word_list(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda l: l.rlike(WORD)).alias("_lines"))
    normal = F.transform("_lines", lambda l: F.trim(F.lower(F.regexp_replace(l, GAP, " "))))
    parts = parts.select("*", normal.alias("_normal"))
    return parts.select(
        *KEY, "doc_id", "_host",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.transform("_normal", lambda l: F.struct(
            F.xxhash64(F.col("_host"), l).alias("h"),
            (F.length(l) - F.length(F.replace(l, F.lit(" "))) + 1).alias("w"))).alias("_hashes"),
        F.monotonically_increasing_id().alias("_row"))


def quality_report(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT,
                   doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: the row key, doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, words_removed, lines_removed (places among the lines with a
    word), depleted, kept.

    Distinct documents are counted per host and line, rows of one doc_id as one document and rows
    without doc_id by their content; a line above ``max_docs`` goes from every document, whatever
    other documents the host has. Null text has no words and fails the base rules; a null host is a
    host of its own; an empty table gives no rows. The narrow features are staged once; a hot host or line
    spreads, for lines are counted by a hash of host and line with partial sums, only lines in
    more rows than ``max_docs`` have their documents told apart (spread by document), and the
    join back to the lines can be split by adaptive execution."""
    features = stage(document_features(docs, doc_id, text, host), "line-features")
    lines = features.select("_row", "doc_id", KEY[1], F.posexplode("_hashes").alias("pos", "_l")).select(
        "_row", "doc_id", F.when(F.col("doc_id").isNull(), F.col(KEY[1])).alias("_content"), "pos",
        F.col("_l.h").alias("h"), F.col("_l.w").alias("w"))
    in_rows = features.select(F.explode(F.array_distinct("_hashes.h")).alias("h")).groupBy("h").agg(
        F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > max_docs).select("h")
    often = lines.join(in_rows, "h")
    frequent = (often.select("h", "doc_id", "_content").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("_in_docs"))
                .filter(F.col("_in_docs") > max_docs).select("h"))
    removed = often.join(frequent, "h").groupBy("_row").agg(
        F.sum("w").alias("_removed"), F.collect_list("pos").alias("_places"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = features.drop("_hashes", "_host").join(removed, "_row", "left").select(
        *KEY, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), F.coalesce("_removed", F.lit(0)).cast("long").alias("words_removed"),
        F.coalesce("_places", F.array().cast("array<int>")).alias("lines_removed"))
    depleted = (F.col("n_words") - F.col("words_removed")) < F.lit(min_left) * F.col("n_words")
    return judged.withColumn("depleted", depleted).withColumn(
        "kept", ~F.col("base_failed") & ~F.col("depleted"))


def apply_quality_rules(docs: DataFrame, text: str = "text", chars: str | None = "n_chars",
                        doc_id: str = "doc_id", host: str = "source", **limits) -> DataFrame:
    """The kept documents with their frequent lines taken out, in the columns of ``docs``.

    ``chars``, where ``docs`` has it, is set to the new length. Limits and odd inputs as in
    :func:`quality_report`; rows alike in every column stay or go together."""
    report = quality_report(docs, doc_id=doc_id, text=text, host=host, **limits)
    kept = (report.filter("kept").groupBy(*KEY)
            .agg(F.max_by("lines_removed", F.size("lines_removed")).alias("_places")))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    keyed = docs.select(*row_key(docs, doc_id),
                        *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    on = [keyed[KEY[0]].eqNullSafe(kept[KEY[0]]), keyed[KEY[1]] == kept[KEY[1]]]
    joined = keyed.join(kept, on).select("_places", *names)
    body = F.col(names[docs.columns.index(text)])

    def without(lines: Column) -> Column:
        worded = F.filter(F.sequence(F.lit(0), F.size(lines) - 1),
                          lambda i: F.get(lines, i).rlike(WORD))
        gone = F.get(F.transform(F.array(worded), lambda w: F.transform("_places", lambda p: F.get(w, p))), F.lit(0))
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    cleaned = F.when(F.size("_places") == 0, body).otherwise(
        F.get(F.transform(F.array(F.split(body, "\n")), without), F.lit(0)))
    out = joined.withColumn("_cleaned", cleaned)
    columns = []
    for c, n in zip(docs.columns, names):
        if c == text:
            columns.append(F.col("_cleaned").alias(c))
        elif c == chars:
            columns.append(F.when(F.size("_places") == 0, F.col(n)).otherwise(
                F.length("_cleaned").cast(docs.schema[c].dataType)).alias(c))
        else:
            columns.append(F.col(n).alias(c))
    return out.select(*columns)
