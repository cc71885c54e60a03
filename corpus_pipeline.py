"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of their input in their order. Filters decide row by row: a stage numbers its rows first, so a row without an id,
or one that shares its id with others, stays or goes by its own text. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.llm import near_dedup, packing, pii, quality_rules
from ledgerlink.llm import toxicity as toxic
from ledgerlink.llm.common import fresh, table
from ledgerlink.runtime import materialise, prepare


#: At most so many row numbers are broadcast to a filter; beyond it the join shuffles both sides.
BROADCAST_ROWS = 1_000_000


def _numbered(docs: DataFrame, stage: str) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, written so that the numbers stand, and the number's column."""
    key = fresh(docs.columns, "row_number")
    return materialise(docs.withColumn(key, F.monotonically_increasing_id()), f"pipeline-{stage}"), key


def _without(docs: DataFrame, key: str, rejected: DataFrame, stage: str) -> DataFrame:
    """``docs`` without the rows whose numbers ``rejected`` names in doc_id, and without the numbers."""
    gone = materialise(rejected.select(F.col("doc_id").alias(key)), f"pipeline-{stage}-rejected")
    left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, key, "left_anti")
    return left.drop(key)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go; null and empty texts score as the class shares say."""
    prepare(spark)
    rows, key = _numbered(docs, "toxicity")
    scored = toxic.toxicity(rows, table(spark, sf_dir, "labels"), id_col=key, fit_on=docs.select(F.col("doc_id").alias(key), "text"))
    return _without(rows, key, scored.where("predicted = 1"), "toxicity")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base or a certified rule rejects go, null and empty texts among them."""
    prepare(spark)
    rows, key = _numbered(docs, "quality")
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality").join(rows.select("doc_id", F.col(key).alias("number_")), "doc_id").select(F.col("number_").alias("doc_id"), "quality")
    verdicts = quality_rules.quality_rules(rows, marks, id_col=key)
    return _without(rows, key, verdicts.where("not kept"), "quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that with the smallest id (a null id last); a repeated row is a copy.

    Null, empty and wordless texts are copies of nothing.
    """
    prepare(spark)
    rows, key = _numbered(docs, "dedup")
    groups = near_dedup.near_duplicates(rows, id_col=key).select(F.col("doc_id").alias(key), "component_id")
    named = materialise(groups.join(rows.select(key, "doc_id"), key), "pipeline-dedup-groups")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)
    first = named.groupBy("component_id").agg(F.min(place).alias("first")).select(F.col(f"first.{key}").alias(key))
    return _without(rows, key, named.join(first, key, "left_anti").select(F.col(key).alias("doc_id")), "dedup")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind; ``n_chars`` follows the text, null for a null one."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 tokens; a null or empty text is the end token alone."""
    prepare(spark)
    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Exact nearest examples, tokenizers and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
