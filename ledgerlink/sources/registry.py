"""Saved pages of a registry's JSON interface, and JSON artifacts of pairs and splits."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
RECORD = T.StructType([T.StructField(c, _S) for c in ("source", "source_id", "legal_name")] + [T.StructField("other_names", T.ArrayType(_S))] + [T.StructField(c, _S) for c in ("country", "jurisdiction", "legal_form_id", "registration_authority", "registered_as", "city", "postal_code")] + [T.StructField("address_lines", T.ArrayType(_S))])
PAIR = T.StructType([T.StructField(c, _S) for c in ("pair_id", "source", "left_id", "right_id", "label", "label_basis", "source_revision")] + [T.StructField("blocking_keys", T.ArrayType(_S)), T.StructField("variant_types", T.ArrayType(_S)), T.StructField("left", RECORD), T.StructField("right", RECORD)])
PAGE = "data array<struct<attributes struct<lei string, entity struct<legalName struct<name string>, otherNames array<struct<name string>>, legalAddress struct<country string, city string, postalCode string, addressLines array<string>>, jurisdiction string, legalForm struct<id string>, registeredAt struct<id string>, registeredAs string, successorEntity struct<lei string>, status string>, registration struct<status string>>>>, meta struct<goldenCopy struct<publishDate string>>"


def read_pages(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Payloads of saved pages, one row each, with the page's publish date; ``limit`` keeps the first by id."""
    pages = spark.read.schema(PAGE).json(path, multiLine=True)
    rows = pages.select(F.explode("data").alias("payload"), F.col("meta.goldenCopy.publishDate").alias("published"))
    return rows if limit is None else rows.orderBy("payload.attributes.lei").limit(limit)


def flat_record(rows: DataFrame, source: str = "gleif") -> DataFrame:
    """Payloads as records. Absent objects give nulls; other names without a name are left out."""
    a, e = "payload.attributes", "payload.attributes.entity"
    names = F.filter(F.transform(F.col(f"{e}.otherNames"), lambda n: n["name"]), lambda n: n.isNotNull() & (n != ""))
    none = F.array().cast("array<string>")
    return rows.select(
        F.lit(source).alias("source"), F.col(f"{a}.lei").alias("source_id"), F.col(f"{e}.legalName.name").alias("legal_name"), F.coalesce(names, none).alias("other_names"),
        F.col(f"{e}.legalAddress.country").alias("country"), F.col(f"{e}.jurisdiction").alias("jurisdiction"), F.col(f"{e}.legalForm.id").alias("legal_form_id"), F.col(f"{e}.registeredAt.id").alias("registration_authority"),
        F.col(f"{e}.registeredAs").alias("registered_as"), F.col(f"{e}.legalAddress.city").alias("city"), F.col(f"{e}.legalAddress.postalCode").alias("postal_code"), F.coalesce(F.col(f"{e}.legalAddress.addressLines"), none).alias("address_lines"),
    )


def revision(rows: DataFrame) -> DataFrame:
    """One row: the publish date's day of the pages, else today's."""
    return rows.agg(F.coalesce(F.left(F.max("published"), F.lit(10)), F.current_date().cast("string")).alias("revision"))


def missing_ids(wanted: DataFrame, cached: DataFrame, column: str = "source_id") -> DataFrame:
    """Distinct non-empty wanted ids that the cache lacks."""
    ids = wanted.select(column).where(F.coalesce(F.col(column), F.lit("")) != "").distinct()
    return ids.join(cached.select(column).distinct(), column, "left_anti")


def lookup_ids(wanted: DataFrame, records: DataFrame, column: str = "source_id") -> DataFrame:
    """Records of the wanted ids, each once."""
    return records.join(wanted.select(column).where(F.col(column).isNotNull()).distinct(), column, "left_semi").dropDuplicates([column])


def read_through(wanted: DataFrame, cached: DataFrame, fetched: DataFrame, column: str = "source_id") -> DataFrame:
    """The cache and those fetched records that were missing from it."""
    return cached.unionByName(lookup_ids(missing_ids(wanted, cached, column), fetched, column), allowMissingColumns=True)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of an artifact; a missing file is an error that names it."""
    local = path.removeprefix("file://")
    if "://" not in local and not os.path.exists(local):
        raise FileNotFoundError(f"artifact {path} is missing; build it first")
    return spark.read.schema(PAIR).json(path)


def serialise_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with the ids of both sides beside the nested records."""
    return pairs.select("pair_id", F.col("left.source").alias("source"), F.col("left.source_id").alias("left_id"), F.col("right.source_id").alias("right_id"), "label", "label_basis", "source_revision", "blocking_keys", "variant_types", "left", "right")


def write_artifact(df: DataFrame, path: str, format: str = "json") -> None:
    df.write.mode("overwrite").format(format).save(path)
