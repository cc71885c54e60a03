"""Helpers of the training-text operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerlink.runtime import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Gives freed memory back to the system, as far as the allocators let it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[list], dict]]) -> DataFrame:
    """``make()`` gives, once a task, a function from lists of input columns to a dict of output columns.

    It sees one Arrow batch at a time, so memory is that of a batch whatever the partition's size. Workers
    serve many tasks: what a task remembered goes back to the system when it ends.
    """
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        got: dict = {}
        for batch in batches:
            got = work(*[c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)
        del work, got
        release()

    return df.mapInArrow(run, out)


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores added until no input column has it (compared as Spark does, without case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def slim(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed: columns with other names in the input cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])
