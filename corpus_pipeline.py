"""From raw documents to token files: the stages of the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from offerflow.llm.decontaminate import decontaminated
from offerflow.llm.jaccard import one_of_each
from offerflow.llm.line_rules import apply_quality_rules
from offerflow.llm.mixing import mixed_documents
from offerflow.llm.queries import table, vocabulary
from offerflow.llm.token_files import token_table
from offerflow.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that their host repeats too
    often."""
    return apply_quality_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out so that the sources meet their target weights."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in doc_id order, and per row what they hold of it."""
    return token_table(docs, vocabulary("byte_bpe_50k.json"), 2)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates),
          ("decontamination", decontaminate), ("source mix", mix), ("token files", tokens)]

#: Tokens and near-duplicate groups cannot be expressed in SQL; tests/llm hold each stage
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as a table and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, "pipeline")
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: the rows of :func:`run`."""
    return run(spark, sf_dir)
