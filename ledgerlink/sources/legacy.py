"""Two legacy schemas in one shape, and their crosswalk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlink.functions.names import record_key

NUMBERED_NAMES = 10
#: Registration authority whose numbers are those of the numbered register (fixed value).
NUMBERED_AUTHORITY = "RA000585"

REGISTRY_SCHEMA = T.StructType([T.StructField(c, T.StringType(), c not in ("lei", "legal_name")) for c in "lei legal_name legal_form country city postal_code address_line registered_at registered_as registration_status successor_lei".split()])
OTHER_NAME_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("lei", "name_type", "name")])
NUMBERED_SCHEMA = T.StructType([T.StructField(c, T.StringType(), c not in ("company_number", "company_name")) for c in ["company_number", "company_name", "company_status", "country_of_origin", "post_town", "post_code", "address_line_1", *[f"previous_name_{k}" for k in range(1, NUMBERED_NAMES + 1)]]])
_SHAPE = ["source", "source_id", "legal_name", "country", "city", "postal_code", "address_line", "registration_authority", "registered_as"]


def load_rows(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """Rows as given by a caller, checked against the schema; absent fields are null, unknown ones refused."""
    unknown = {k for r in rows for k in r} - set(schema.names)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    return spark.createDataFrame([[r.get(c) for c in schema.names] for r in rows], schema)


def _column(df: DataFrame, name: str) -> F.Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def unify(registry: DataFrame, numbered: DataFrame) -> DataFrame:
    """All records of both registers in one shape. A company number is also its registration."""
    a = registry.select(F.lit("gleif").alias("source"), F.col("lei").alias("source_id"), "legal_name", *[_column(registry, c).alias(c) for c in ("country", "city", "postal_code", "address_line")], _column(registry, "registered_at").alias("registration_authority"), _column(registry, "registered_as").alias("registered_as"))
    b = numbered.select(F.lit("companies_house").alias("source"), F.col("company_number").alias("source_id"), F.col("company_name").alias("legal_name"), _column(numbered, "country_of_origin").alias("country"), _column(numbered, "post_town").alias("city"), _column(numbered, "post_code").alias("postal_code"), _column(numbered, "address_line_1").alias("address_line"), F.lit(NUMBERED_AUTHORITY).alias("registration_authority"), F.col("company_number").alias("registered_as"))
    return a.unionByName(b).select(*_SHAPE)


def numbered_names(numbered: DataFrame) -> DataFrame:
    """Previous names, one row each, by their number; absent names give none."""
    cols = [f"previous_name_{k}" for k in range(1, NUMBERED_NAMES + 1) if f"previous_name_{k}" in numbered.columns]
    pairs = F.array(*[F.struct(F.lit(int(c.rsplit("_", 1)[1])).alias("ordinal"), F.col(c).alias("name")) for c in cols])
    return numbered.select(F.col("company_number").alias("source_id"), F.explode(pairs).alias("x")).select("source_id", "x.name", "x.ordinal").where(F.col("name").isNotNull())


def other_names(registry_names: DataFrame | None, numbered: DataFrame) -> DataFrame:
    own = numbered_names(numbered).select(F.lit("companies_house").alias("source"), "source_id", "name", "ordinal")
    if registry_names is None:
        return own
    return registry_names.select(F.lit("gleif").alias("source"), F.col("lei").alias("source_id"), "name", F.lit(0).alias("ordinal")).unionByName(own)


def records(registry: DataFrame, numbered: DataFrame, registry_names: DataFrame | None = None) -> DataFrame:
    """Unified records in order of source and id, other names in order, an empty address as no lines."""
    names = other_names(registry_names, numbered).groupBy("source", "source_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]).alias("other_names"))
    flat = unify(registry, numbered).join(names, ["source", "source_id"], "left")
    line = F.when(F.coalesce(F.col("address_line"), F.lit("")) != "", F.array("address_line")).otherwise(F.array().cast("array<string>"))
    return flat.select(*_SHAPE[:6], line.alias("address_lines"), *_SHAPE[7:], F.coalesce("other_names", F.array().cast("array<string>")).alias("other_names"), record_key(F.col("source"), F.col("source_id")).alias("record_key")).orderBy("source", "source_id")


def crosswalk(registry: DataFrame, numbered: DataFrame) -> DataFrame:
    """Registrations with the numbered register's authority, on exact number."""
    a = registry.where(F.col("registered_at") == NUMBERED_AUTHORITY)
    return a.join(numbered, F.col("registered_as") == F.col("company_number")).select("lei", "company_number", F.col("legal_name").alias("registry_name"), F.col("company_name").alias("numbered_name"))
