"""Session plumbing shared by every operator: shared scratch space, worker imports, batch limits."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent and the master is local (tests) a temporary folder is created and used as
    the checkpoint folder of the session; one process owns all data there, so a local path is right. On a
    cluster it has to be set: executors do not see the driver's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerlink-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors.

    Unlike ``checkpoint()`` the plan runs once, and unlike ``persist()`` no executor owns the data.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep Arrow batches small for very long texts."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark
