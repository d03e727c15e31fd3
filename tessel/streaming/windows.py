"""Structured Streaming over event files: windowed aggregates and keyed incremental results.

An extension: the reference works in batches only. A stream is drained with the files at hand (``availableNow``); its state and its results
live in the shared folder, so a restarted driver goes on where the last batch ended, and a batch that runs twice writes the same folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
     T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())]
)


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The event files of a folder as a stream; ``ts`` becomes a timestamp with the session's zone."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, window: Column, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """(start, end, keys, n, total) per window; rows later than ``late`` behind the newest event are dropped once their window is closed."""
    rows = events.where("ts is not null").withWatermark("ts", late).groupBy(window.alias("w"), *keys)
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("w.start", "w.end", *keys, "n", "total")


def drain(result: DataFrame, folder: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Run the stream over what is there and return its newest row per key.

    Each batch is written to its own folder, so a repeated batch overwrites itself and the sink is exactly-once; in complete mode the newest batch is the result.
    """
    spark = result.sparkSession

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(upsert).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")
    value = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*value), "batch").alias("v")).select(*keys, "v.*")
