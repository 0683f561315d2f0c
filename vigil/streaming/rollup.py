"""The user-day rollup (A2) over an event stream.

Exact distinct counts are not available in streaming aggregations, so the
stream keeps partial aggregates per (user, day, props): the distinct-hosts
count of a user-day is then the number of its partial rows.  The stream runs
in *update* mode with an event-time watermark (state for a day is dropped
once the watermark passes it); every micro-batch appends its updated partial
rows, tagged with the batch id, to a Parquet table.  ``user_day_from_partials``
reads that table, keeps the latest version of each partial row and rolls it
up exactly as the batch rollup does — so the result equals
``user_day_from_events`` over the events that arrived inside the watermark.  An event
more than the watermark (two days by default) behind the latest one is dropped by Spark and
missing here; the query's progress counts such rows (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.params import EVENTS_DAY_ZERO

EVENT_SCHEMA = ("event_id long, ts timestamp_ntz, user_id long, event_type string, "
                "value double, props string")


def partial_rollup(events: DataFrame, day_zero: str = EVENTS_DAY_ZERO,
                   watermark: str = "2 days") -> DataFrame:
    """Streaming (or batch) partial aggregates per (user_id, day, props)."""
    ev = (events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
          .select("user_id", "event_type", "value", "props",
                  F.datediff(F.to_date("ts"), F.to_date(F.lit(day_zero))).alias("day"),
                  F.col("ts").cast("timestamp").alias("_event_time")))
    return (ev.withWatermark("_event_time", watermark)
            .groupBy("user_id", "day", "props", F.window("_event_time", "1 day").alias("_w"))
            .agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("value_sum"),
                 F.count_if(F.col("event_type") == "view").alias("views"),
                 F.count_if(F.col("event_type") == "error").alias("errors"),
                 F.count("*").alias("events"))
            .drop("_w"))


def start_partial_stream(spark: SparkSession, source_dir: str, sink_dir: str,
                         checkpoint_location: str, day_zero: str = EVENTS_DAY_ZERO,
                         watermark: str = "2 days", available_now: bool = True,
                         max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the stream: Parquet event files in ``source_dir`` → partial rows
    appended to ``sink_dir``.  ``checkpoint_location`` must be on shared
    storage; the query restarts from it after a failure."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    partials = partial_rollup(reader.parquet(source_dir), day_zero, watermark)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")) \
            .write.mode("append").parquet(sink_dir)

    writer = (partials.writeStream.outputMode("update").foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def user_day_from_partials(partials: DataFrame, customers: DataFrame) -> DataFrame:
    """Latest version of every partial row → the user-day activity table."""
    latest = (partials.groupBy("user_id", "day", "props")
              .agg(F.max_by(F.struct("value_sum", "views", "errors"), "batch_id").alias("p"))
              .select("user_id", "day", "props", "p.*"))
    rolled = latest.groupBy("user_id", "day").agg(
        F.floor(F.sum("value_sum")).cast("long").alias("bytes"),
        F.sum("views").cast("long").alias("logins"),
        F.count("props").cast("long").alias("hosts"),
        F.sum("errors").cast("long").alias("fails"))
    groups = customers.select(F.col("c_custkey").alias("user_id"),
                              F.col("c_mktsegment").alias("group"))
    return rolled.join(groups, "user_id", "inner").select(
        "user_id", "group", F.col("day").cast("int").alias("day"),
        "bytes", "logins", "hosts", "fails",
        F.lit(False).alias("is_anomaly"), F.lit("").alias("anomaly_type"))
