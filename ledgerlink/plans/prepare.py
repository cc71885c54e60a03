"""Columns that pair operators read, computed once a record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.functions import names as N

#: Least lengths of keys.
LEAST_TOKEN, LEAST_ACRONYM, LEAST_IDENTIFIER = 4, 2, 4


def prepare_records(records: DataFrame) -> DataFrame:
    """Adds record_key, name_norm, core, tok, core_tok, acr, id_norm, ra_norm, ra_up, ctry_up, addr, keys.

    ``records`` holds source, source_id, legal_name, and where known country, city, postal_code,
    address_lines, registration_authority, registered_as. Record keys must be unique.
    """
    have = set(records.columns)
    text = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    lines = F.col("address_lines") if "address_lines" in have else F.array().cast("array<string>")
    base = records.select(
        "source", "source_id", "legal_name", text("country").alias("country"), text("city").alias("city"), text("postal_code").alias("postal_code"),
        text("registration_authority").alias("registration_authority"), text("registered_as").alias("registered_as"), F.coalesce(lines, F.array().cast("array<string>")).alias("address_lines"),
        N.fold_accents(F.col("legal_name")).alias("folded"),
        F.trim(F.concat_ws(" ", lines, F.coalesce(text("city"), F.lit("")), F.coalesce(text("postal_code"), F.lit("")))).alias("address"),
    )
    named = base.withColumn("name_norm", N.normalize_name(F.col("legal_name"), F.col("folded"))).withColumn("core", N.strip_legal_form(F.col("name_norm")))
    full = named.select(
        N.record_key(F.col("source"), F.col("source_id")).alias("record_key"), "source", "source_id", "legal_name", "country", "city", "postal_code", "registration_authority", "registered_as", "address_lines", "name_norm", "core",
        N.tokens(F.col("name_norm")).alias("tok"), N.tokens(F.col("core")).alias("core_tok"), N.acronym(F.col("name_norm")).alias("acr"), N.normalize_identifier(F.col("registered_as")).alias("id_norm"),
        F.nullif(F.upper(F.trim("registration_authority")), F.lit("")).alias("ra_norm"), F.coalesce(F.upper("registration_authority"), F.lit("")).alias("ra_up"), F.nullif(F.upper("country"), F.lit("")).alias("ctry_up"),
        F.lower(N.fold_accents(F.nullif(F.col("address"), F.lit("")))).alias("addr"),
    )
    return full.withColumn("keys", _keys())


def _keys() -> F.Column:
    tag = lambda family, value, fine: F.when(fine, F.concat(F.lit(family + ":"), value))
    norm = F.col("name_norm")
    prefix, longest = N.prefix_key(norm), N.longest_token(norm)
    postal = N.normalize_identifier(F.col("postal_code"))
    return F.array_distinct(F.array_compact(F.array(
        tag("nameprefix", prefix, prefix.isNotNull()),
        tag("acronym", F.col("acr"), F.char_length("acr") >= LEAST_ACRONYM),
        tag("regid", F.col("id_norm"), F.char_length("id_norm") >= LEAST_IDENTIFIER),
        tag("token", F.concat_ws(":", longest, F.col("ctry_up")), longest.isNotNull() & F.col("ctry_up").isNotNull()),
        tag("postal", postal, F.char_length(postal) >= LEAST_IDENTIFIER),
    )))


def unique_keys(records: DataFrame) -> DataFrame:
    """Record keys that occur more than once; empty for valid input."""
    return records.groupBy("record_key").count().where("count > 1")
