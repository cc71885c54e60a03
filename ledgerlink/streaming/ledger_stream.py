"""The ledger as a stream: idempotent intake of events, batch views over what arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlink.operators.ledger import SCHEMA

#: A replay of a key within this span of event time is dropped; later ones fall to the batch view.
REPLAY_SPAN = "7 days"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(folder)


def first_events(events: DataFrame, span: str = REPLAY_SPAN) -> DataFrame:
    """Events whose idempotency key is new within the watermark."""
    timed = events.withColumn("event_time", F.to_timestamp("recorded_at"))
    return timed.withWatermark("event_time", span).dropDuplicatesWithinWatermark(["idempotency_key"])


def start(events: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append deduplicated events to ``folder``; with ``once`` all that is there, then stop."""
    writer = events.drop("event_time").writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
