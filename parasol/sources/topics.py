"""Topics as streaming sources and sinks.

On a cluster with the connector a topic is a Kafka topic. Elsewhere it is a
folder of files with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOPIC_SCHEMA = "key string, value string, topic string"


def read_topic(spark: SparkSession, topic: str, brokers: str | None = None, folder: str | None = None,
               max_per_trigger: int | None = None) -> DataFrame:
    """Stream of (key, value, topic), from the earliest offset."""
    if brokers:
        reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers)
                  .option("subscribe", topic).option("startingOffsets", "earliest"))
        if max_per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
        return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"), "topic")
    reader = spark.readStream.schema("key string, value string")
    if max_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_per_trigger)
    return reader.parquet(f"{folder}/topic={topic}").withColumn("topic", F.lit(topic))


def keyed(df: DataFrame, topic, key: str, value) -> DataFrame:
    kind = F.lit(topic) if isinstance(topic, str) else topic
    return df.select(F.col(key).cast("string").alias("key"), value.alias("value"), kind.alias("topic"))


def publish(rows: DataFrame, checkpoint: str, brokers: str | None = None, folder: str | None = None) -> None:
    """Write a stream of (key, value, topic) to its topics, then stop at the end of input."""
    if brokers:
        writer = rows.writeStream.format("kafka").option("kafka.bootstrap.servers", brokers)
    else:
        writer = rows.writeStream.format("parquet").option("path", folder).partitionBy("topic")
    (writer.option("checkpointLocation", checkpoint).outputMode("append")
     .trigger(availableNow=True).start().awaitTermination())


def land(rows: DataFrame, folder: str) -> None:
    """Append static (key, value, topic) rows to the topic folders."""
    rows.write.mode("append").partitionBy("topic").parquet(folder)
