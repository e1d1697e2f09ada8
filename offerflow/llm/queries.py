"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerflow.llm import (
    decontaminate,
    hash_tree,
    jaccard,
    kneser_ney,
    licenses,
    line_rules,
    merkle,
    mixing,
    personal_data,
    pivot_clusters,
    secret_links,
    token_counts,
    token_files,
)
from offerflow.llm.oracles import ORACLES  # noqa: F401 - the entry takes queries and twins from here


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_matches(table(spark, sf_dir, "documents"))
    best = F.get("matches", F.lit(0))
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"), best["license"].alias("license"),
        best["score"].alias("score"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["unit"], m["start"], m["end"])), ",")
        .alias("spans"))


def op4_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.assign_shards(table(spark, sf_dir, "documents"),
                                   hash_tree.even_tree(16), hash_tree.even_tree(17))


def op5_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_links.secret_spans(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"),
                        F.sha2(secret_links.span_text("base"), 256).alias("base_sha256"),
                        secret_links.span_text("spans").alias("spans"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2)


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.quality_report(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "words_removed")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


def op10_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    return merkle.manifest_table(docs, tampered, {"n_chars": more})


def op12_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_clusters.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.personal_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(personal_data.span_text("base"), 256).alias("base_sha256"), personal_data.span_text("spans").alias("spans"),
        F.transform("spans", lambda s: s["score"]).alias("scores"))


QUERIES = {f.__name__: f for f in (
    op1_kneser_ney, op2_source_mix, op3_license_scan, op4_hash_tree_shards, op5_secret_links, op6_token_files, op7_line_quality,
    op8_token_counts, op9_ngram_jaccard, op10_fm_decontamination, op11_merkle_manifest, op12_pivot_clusters, op13_personal_data)}
