"""Candidate pairs by shared block keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.runtime import materialise

#: Blocks of fewer or more records give no pairs.
LEAST_BLOCK, MOST_BLOCK = 2, 200
FAMILIES = ("nameprefix", "acronym", "regid", "token", "postal")


def index_by_key(prepared: DataFrame) -> DataFrame:
    """(block_key, record_key): one row for each key of each record."""
    return prepared.select(F.explode("keys").alias("block_key"), "record_key")


def block_sizes(prepared: DataFrame) -> DataFrame:
    return index_by_key(prepared).groupBy("block_key").agg(F.count(F.lit(1)).alias("n"))


def usable_index(prepared: DataFrame) -> DataFrame:
    """The index without singletons and oversize blocks, written: its users read it more than once.

    Names are normalised once for counting, filtering and both sides of a self-join.
    """
    index = materialise(index_by_key(prepared), "blocking-index")
    fine = index.groupBy("block_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(LEAST_BLOCK, MOST_BLOCK)).select("block_key")
    return materialise(index.join(fine, "block_key", "left_semi"), "blocking-index")


def candidate_pairs(prepared: DataFrame) -> DataFrame:
    """(left_key, right_key, reasons): each unordered pair that shares a usable key, once, reasons sorted.

    The ceiling bounds a key at MOST_BLOCK * (MOST_BLOCK - 1) / 2 pairs, so no key is hot. Only keys travel
    through the join; records are attached afterwards.
    """
    index = usable_index(prepared)
    left = index.select("block_key", F.col("record_key").alias("left_key"))
    right = index.select("block_key", F.col("record_key").alias("right_key"))
    pairs = left.join(right, "block_key").where("left_key < right_key")
    return pairs.groupBy("left_key", "right_key").agg(F.sort_array(F.collect_set("block_key")).alias("reasons"))


def attach(pairs: DataFrame, prepared: DataFrame) -> DataFrame:
    """Both records' columns beside each pair, with ``l_`` and ``r_`` before their names."""
    side = lambda s, key: prepared.select(*[F.col(c).alias(f"{s}_{c}") for c in prepared.columns]).withColumnRenamed(f"{s}_record_key", key)
    return pairs.join(side("l", "left_key"), "left_key").join(side("r", "right_key"), "right_key")


def shared_keys(left: Column, right: Column) -> Column:
    return F.array_sort(F.array_intersect(left, right))


def family(key: Column) -> Column:
    return F.substring_index(key, ":", 1)
