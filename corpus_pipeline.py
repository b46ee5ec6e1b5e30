"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Filtering stages keep whole rows of their input, with its columns; the last stage returns where every token piece is packed.
A rejected document is gone for all later stages. The classifying stages filter in their own scan; near-dedup meets its
verdicts by doc_id, so rows that share an id stand or fall together, and of rows equal in id and text one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import chaining, cotraining, kernels, near_dedup, quality_rules
from tallymark.llm.queries import packed, table
from tallymark.llm.scratch import Scratch
from tallymark.workers import ready


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules or the fitted verdict reject go; a null or empty text goes, repeated rows fare alike."""
    ready(spark)
    return quality_rules.keep_rows(docs, table(spark, sf_dir, "labels"))


def apply_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the co-trained classifier rejects go; it is fitted on all of `documents`, as the rules before it leave few bad labelled rows."""
    ready(spark)
    return cotraining.keep_rows(docs, table(spark, sf_dir, "labels"), fit_on=table(spark, sf_dir, "documents"))


def apply_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle near copies stays: that of the smallest id (a null id only in a group of such)."""
    ready(spark)
    id_, text = kernels.fresh(docs.columns, "kept_id", "text_hash")
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias(id_)).distinct()
    stay = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi")
    return stay.withColumn(text, F.md5("text")).dropDuplicates(["doc_id", text]).drop(text)


def apply_substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut from all documents but the first; every row stays, if need be with an empty text."""
    ready(spark)
    return chaining.remove_passages(docs)


def apply_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every token piece of every row is packed; an empty text packs as its end mark."""
    ready(spark)
    return packed(docs).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", apply_quality_rules),
    ("quality classifier", apply_classifier),
    ("MinHash near-dedup", apply_near_dedup),
    ("substring dedup", apply_substring_dedup),
    ("best-fit packing", apply_packing),
]

#: The classifiers and the chaining have no SQL; the stages are tested one by one against brute force and held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs)
    return docs
