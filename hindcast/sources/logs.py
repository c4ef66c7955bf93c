"""Log records: the Kafka source schema ``(topic, partition, offset, key,
timestamp, value)`` (S1).  The Kafka connector jar is not on this classpath, so
batch and streaming readers take the records from any DataFrame with these
columns: a replay of a landed raw table, or a file-source stream of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Admission:
    """When a micro-batch closes: at ``records`` records or after ``delay``,
    whichever comes first.  Files can't be cut by records; there it closes at
    ``n_bytes`` of files (always at least one file)."""

    records: int = 500
    delay: str = "1h"
    n_bytes: int = 256 * 1024 * 1024

    def of_kafka(self) -> dict[str, str]:
        return {"minOffsetsPerTrigger": str(self.records), "maxOffsetsPerTrigger": str(self.records),
                "maxTriggerDelay": self.delay}

    def of_files(self) -> dict[str, str]:
        return {"maxBytesPerTrigger": str(self.n_bytes)}


def log_records(raw: DataFrame) -> DataFrame:
    """A raw event table's log coordinates and payload as log records."""
    return raw.select(
        F.col("kafka_topic").alias("topic"),
        F.col("kafka_partition").cast("int").alias("partition"),
        F.col("kafka_offset").alias("offset"),
        F.col("kafka_key").alias("key"),
        F.col("kafka_timestamp").alias("timestamp"),
        F.col("payload").alias("value"),
    )


def kafka_source(spark, servers: str, topics: list[str], starting: str = "earliest",
                 admission: Admission = Admission()) -> DataFrame:
    """S1/S2 on a cluster with the Kafka connector: a stream of log records
    from the earliest offsets (value decoded as UTF-8 text)."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", ",".join(topics)).option("startingOffsets", starting)
           .options(**admission.of_kafka()).load())
    return raw.select("topic", "partition", "offset", F.col("key").cast("string").alias("key"),
                      "timestamp", F.col("value").cast("string").alias("value"))
