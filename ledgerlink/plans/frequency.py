"""Document frequencies of tokens and identifiers, and what depends on them once a record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A token in this share of records is common; the least count that makes one so.
COMMON_SHARE, LEAST_COMMON = 0.01, 2


def token_frequency(prepared: DataFrame) -> DataFrame:
    return prepared.select(F.explode("core_tok").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def identifier_frequency(prepared: DataFrame) -> DataFrame:
    """Records of each authority and number."""
    key = F.concat_ws("|", "ra_norm", "id_norm")
    known = prepared.where(F.col("ra_norm").isNotNull() & F.col("id_norm").isNotNull())
    return known.groupBy(key.alias("id_key")).agg(F.count(F.lit(1)).alias("df"))


def with_frequencies(prepared: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Adds id_df (1 where unknown) and rare_tok (identifying tokens; all core tokens if none is rare).

    Frequencies are those of ``population``. Only tokens over the ceiling are needed; each covers a
    hundredth of the records, so their number is bounded by a hundred times a name's tokens, and they
    travel as one array.
    """
    source = prepared if population is None else population
    total = source.agg(F.count(F.lit(1)).alias("total"))
    frequent = token_frequency(source).join(F.broadcast(total), F.lit(True)).where(F.col("df") >= F.greatest(F.lit(LEAST_COMMON), F.floor(F.col("total") * COMMON_SHARE)))
    common = frequent.agg(F.coalesce(F.collect_set("token"), F.array().cast("array<string>")).alias("common"))
    ids = identifier_frequency(source)
    joined = prepared.withColumn("id_key", F.when(F.col("ra_norm").isNotNull() & F.col("id_norm").isNotNull(), F.concat_ws("|", "ra_norm", "id_norm"))).join(ids, "id_key", "left").join(F.broadcast(common), F.lit(True))
    rare = F.array_except("core_tok", "common")
    return joined.withColumn("id_df", F.coalesce("df", F.lit(1))).withColumn("rare_tok", F.when(F.size(rare) > 0, rare).otherwise(F.col("core_tok"))).drop("common", "df", "id_key")


def split_local(pairs: DataFrame, prepared: DataFrame) -> DataFrame:
    """The records of ``pairs`` (left_key, right_key), each once, as a population for frequencies."""
    known = pairs.select("left_key").unionAll(pairs.select("right_key")).distinct().toDF("record_key")
    return prepared.join(known, "record_key", "left_semi")
